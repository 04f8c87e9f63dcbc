"""Pure kernels against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from termloom.llm import embed, gru, langid, lm, mixing, packing, quality, simhash, simple8b, spans, substring, subwords


@pytest.mark.parametrize("high", [1, 2, 40, 50257, 1 << 31, 1 << 59, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 511, 512, 513, 3000])
def test_simple8b_round_trip(n, high):
    v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    v[::7] = 0
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words) == v).all()
    assert len(offsets) == -(-n // 512)
    if n > 2:
        assert (simple8b.decode_from(words, offsets, n // 3, n // 2) == v[n // 3 : n // 3 + n // 2]).all()


def test_subwords_equal_the_library():
    path = subwords.vocabulary_path()
    library, ours, r = Tokenizer.from_file(path), subwords.Encoder(path, memory=50), random.Random(0)
    parts = ["a", "b", "é", "1", " ", " ", "  ", "\n", "'s", "don't", "!", "..", "中文", "\x1c", "́", "²", "<|endoftext|>", " ", "\xa0", "I'm", "hello", "World"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert ours.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert ours.encode(None) == b""


@pytest.mark.parametrize("n", [0, 1, 3, 1023, 1024, 1025, 5000])
def test_pieces(n):
    got = packing.pieces(n, 1024)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got) and got == sorted(got, reverse=True)


def test_fingerprint_by_the_book():
    for text in (None, "", " \t", "One", "One two", "The cat sat on the mat the cat sat", "É É É É ü"):
        words = (text or "").encode().translate(simhash.LOWER).split()
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes[:300] ^ np.uint64(5), codes[:300] ^ np.uint64(1 << 40), codes[:50] ^ np.uint64(7)]))
    got = {(a, b) for who, where in simhash.GrayIndex(codes).search(codes, 2) for a, b in zip(who.tolist(), where.tolist())}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(codes[:, None] ^ codes) <= 2))))


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], 4)
    ids = rng.integers(0, 5, (6, 3))
    ids[4:, 2] = langid.PAD
    truth = np.array([0, 1, 2])
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    _, g = net.gradients(ids, truth)
    for name, w in net.weights.items():
        i = (2, int(ids[0, 0])) if name.startswith("table") else tuple(rng.integers(0, s) for s in w.shape)
        old, sides = w[i], []
        for step in (1e-2, -1e-2):
            w[i] = old + step
            sides.append(net.gradients(ids, truth)[0])
        w[i] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - g[name][i]) < 2e-4


def test_states_continue_across_windows():
    rng = np.random.default_rng(2)
    table, inner, ids = rng.normal(size=(12, 9)).astype("f4"), rng.normal(size=(12, 4)).astype("f4"), rng.integers(0, 8, (10, 5))
    whole = gru.run_states(ids, table, inner, 8)
    first = gru.run_states(ids[:4], table, inner, 8)
    assert np.allclose(whole[4:], gru.run_states(ids[4:], table, inner, 8, None, first[-1]))


def test_language_model_is_normalised_and_window_free():
    model = lm.Model([9, 5, 4, 3, 2], 7, 2, 4)
    rng = np.random.default_rng(0)
    model.weights = {k: (w + rng.normal(0, 0.3, w.shape)).astype("f4") for k, w in model.weights.items()}
    state = rng.normal(size=(4, 1)).astype("f4")
    assert abs(sum(np.exp(model.log_probabilities(state, np.array([i]))[0]) for i in range(6)) - 1) < 1e-5
    texts = [np.array([0, 1, 5, 3, 2]), np.array([2]), np.array([4, 4, 4, 1, 0, 0, 2])]
    alone = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(model.score(texts, steps=2), alone) and np.allclose(model.score(texts, steps=64), alone)
    before = model.score(texts).sum()
    model.train(texts * 30, 0.1)
    assert model.score(texts).sum() > before


def test_suffix_automaton_matching():
    r = random.Random(5)
    for _ in range(60):
        refs = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for ref in refs:
            automaton.add(ref)
        words = [r.choice("abcd") for _ in range(15)]
        held = {tuple(ref[i:j]) for ref in refs for i in range(len(ref)) for j in range(i + 1, len(ref) + 1)}
        want = [max([n for n in range(i + 2) if n == 0 or tuple(words[i + 1 - n : i + 1]) in held]) for i in range(15)]
        assert automaton.matching(words) == want


def test_pfair_frames():
    for trial in range(60):
        r = random.Random(trial)
        weights = {f"s{i}": r.random() ** 3 + 1e-3 for i in range(r.randint(1, 20))}
        slots = mixing.quotas(weights, r.choice([20, 100, 500]))
        count = dict.fromkeys(slots, 0)
        for t, (name, block, release, deadline) in enumerate(mixing.pfair_frame(slots)):
            assert release <= t < deadline and block == count[name]
            count[name] += 1
            assert all(abs(count[n] - (t + 1) * a / sum(slots.values())) < 1 for n, a in slots.items())
    with pytest.raises(ValueError):
        mixing.quotas({"a": 0.0, "b": 1.0}, 10)


def test_words_and_features_do_not_cross_texts():
    texts = ["ab cd  ef", "", None, " x", "a b c", "\té\n", "x x x"]
    data, offsets = spans.flat(pa.array(texts))
    starts, ends, first = spans.words(data, offsets)
    got = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    joint = quality.features(data, offsets)
    for i, t in enumerate(texts):
        alone = [x for rows, f in quality.features(*spans.flat(pa.array([t], pa.string()))) for x in rows[f[0] : f[1]].tolist()]
        assert sorted(alone) == sorted(x for rows, f in joint for x in rows[f[i] : f[i + 1]].tolist())


def test_block_joins_and_stars():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 12))
    x[40:90] = x[:50] + rng.normal(0, 0.12, (50, 12))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = u @ u.T >= 0.93
    np.fill_diagonal(want, False)
    axes = np.linalg.eigh(np.cov(u.T))[1][:, ::-1]
    assert (embed.join_blocks(x, None, axes, 0.93) == want).all() and want.any()
    assert (embed.join_blocks(x[:70], x[70:], axes, 0.93) == want[:70, 70:]).all()
    labels, _ = embed.local_stars(want, True)
    for i, j in zip(*np.nonzero(want)):
        assert labels[i] == labels[j]
    assert zlib.crc32(b"") == 0
