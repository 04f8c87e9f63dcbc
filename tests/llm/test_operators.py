"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, extra columns, and no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import components, embed, exact, langid, lm, mixing, packing, quality, simhash, similar, store, substring, subwords, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, salt string, body string, code string, mark string, s string, part string"
EXTRA = ("x",) * 7
WORD = {"en": "the and of is with from".split(), "fr": "les une dans être déjà où".split()}


def make_text(r, lang, n):
    return " ".join(r.choice(WORD[lang]) + r.choice(["", "a", "e", "o"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(i, make_text(r, "en" if i % 2 else "fr", r.randint(5, 90)), "en" if i % 2 else "fr", f"s{i % 3}", i) for i in range(60)]
    passage = make_text(r, "en", 70)
    out += [(100 + i, make_text(r, "en", 20) + " " + passage + " " + make_text(r, "en", i), "en", "s0", 1) for i in range(4)]
    out += [(200, out[3][1], "en", "s0", 1), (201, out[3][1], "en", None, 1), (202, None, "en", "s1", 0), (203, "", None, "s1", 0), (204, " \t\n", "fr", "s2", 3)]
    out += [(205, "12 34 %", None, "s2", 7), (206, make_text(r, "fr", 9000), "fr", "s2", None), (5, out[5][1], "en", "s0", 1), (None, out[5][1], "en", "s0", None), (None, None, None, None, None)]
    return [(*x, *EXTRA) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    got = exact.sorted_copies(docs).collect()
    assert len(got) == len(rows)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, *_ in rows}
    for r in got:
        same = groups[texts[r.text_sha256]]
        top = max((i for i in same if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(same), r.doc_id == top)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and collections.Counter(r.text or "" for r in kept.collect()) == dict.fromkeys(groups, 1)
    assert all(r.doc_id == max((i for i in groups[r.text or ""] if i is not None), default=None) for r in kept.collect())
    assert exact.sorted_copies(empty).count() == exact.drop_copies(empty).count() == 0


def test_exact_copies_meet_in_one_run(spark):
    """The sort, not the digest, brings ordinary copies together; only a frequent text has several runs."""
    r = random.Random(9)
    texts = [make_text(r, "en", 12) for _ in range(400)]
    data = [(i, texts[i % 400]) for i in range(1200)] + [(5000 + i, texts[7]) for i in range(900)]
    names = "_mine string, body string, row string, digest string, place string, salted string, mark string"
    table = spark.createDataFrame([(*x, *EXTRA) for x in data], f"doc_id long, text string, {names}").repartition(7)
    runs, frequent = exact._runs(table, "text", "doc_id")
    firsts = collections.Counter(x.body for x in runs.where("place = 1").collect())
    assert firsts.pop(texts[7]) > 1 and set(firsts.values()) == {1} and len(firsts) == 399 and frequent.count() == 1
    want = {t: max(i for i, x in data if x == t) for t in texts}
    got = exact.sorted_copies(table).collect()
    size = collections.Counter(t for _, t in data)
    assert sorted((x.doc_id, x.keep_id, x.group_size) for x in got) == sorted((i, want[t], size[t]) for i, t in data)
    kept = exact.drop_copies(table)
    assert kept.columns == table.columns and {x.text: x.doc_id for x in kept.collect()} == want and kept.count() == 400 and kept.first()._mine == "x"


def test_simhash(docs, rows, empty):
    got = simhash.near_copies(docs).collect()
    assert len(got) == len(rows)
    codes = {f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}" for _, t, *_ in rows}
    assert {r.fingerprint for r in got} == codes
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in codes:
        for b in codes:
            if bin(int(a, 16) ^ int(b, 16)).count("1") <= 2:
                parent[find(a)] = find(b)
    low = {}
    for r in got:
        if r.doc_id is not None:
            low[find(r.fingerprint)] = min(low.get(find(r.fingerprint), r.doc_id), r.doc_id)
    assert all(r.component_id == low.get(find(r.fingerprint)) for r in got)
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert simhash.near_copies(empty).count() == simhash.drop_near_copies(empty).count() == 0


def test_near_copies_are_dropped_by_row(spark):
    r = random.Random(3)
    a, b, c, d = (make_text(r, "en", 60) for _ in range(4))
    table = spark.createDataFrame([(5, a), (5, b), (3, b.upper()), (None, b), (None, c), (None, d), (7, c)], "doc_id long, text string")
    got = {(x.doc_id, x.text) for x in simhash.drop_near_copies(table).collect()}
    assert got == {(5, a), (3, b.upper()), (None, d), (7, c)}


def test_language_stage_judges_rows(spark):
    r = random.Random(4)
    data = [(i, make_text(r, "en" if i % 2 else "fr", 60), "en" if i % 2 else "fr") for i in range(40)]
    data += [(5, None, None), (None, "12 34", None), (None, data[3][1], "en")]
    table = spark.createDataFrame([(*x, "s", 1) for x in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(x.doc_id, x.text) for x in corpus_pipeline.language(spark, table, "").collect()}
    assert (5, data[5][1]) in got and (None, data[3][1]) in got and not {(5, None), (None, "12 34")} & got
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == 41


@pytest.mark.parametrize("broadcast", [substring.BROADCAST_BYTES, -1])
def test_substring(docs, rows, empty, broadcast, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", broadcast)
    if broadcast < 0:  # many pieces and shards
        monkeypatch.setattr(substring, "PIECE_BYTES", 100)
        monkeypatch.setattr(substring, "SHARD_BYTES", 1000)
    width = 50
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, w in split:
        gone = {p for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = substring.remove_repeats(docs, width).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    assert collections.Counter(map(tuple, got)) == want and any(r.n_removed for r in got)
    assert substring.remove_repeats(empty).count() == 0


def test_token_files(spark, docs, rows, empty):
    path, coder = store.scratch(spark, "t"), subwords.encoder(subwords.vocabulary_path())
    tokens.write_tokens(docs, path, subwords.vocabulary_path(), chunk_ids=500)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = collections.Counter((i, tuple(np.frombuffer(coder.encode(t), "<u4").tolist() + [2])) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    none = store.scratch(spark, "none")
    tokens.write_tokens(empty, none, subwords.vocabulary_path())
    assert tokens.read_tokens(spark, none).count() == 0


def test_packing(docs, rows, empty):
    coder = subwords.encoder(subwords.vocabulary_path())
    got = packing.pack(docs, subwords.vocabulary_path()).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket == len(r.ids) <= 1024 for r in got)
    assert sum(r.length for r in got) == sum(len(coder.encode(t)) // 4 + 1 for _, t, *_ in rows)
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id >> 33, r.sequence_id)):  # the pieces of a row follow each other
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.start == 0:
            last = whole.setdefault((r.doc_id, r.sequence_id), [])
        assert r.start == len(last)
        last += r.ids
        assert len(last) <= r.doc_tokens and (r.length == 1024 or r.doc_tokens - r.start < 1024)
    want = collections.Counter((i, tuple(np.frombuffer(coder.encode(t), "<u4").tolist() + [0])) for i, t, *_ in rows)
    assert collections.Counter((k, tuple(ids)) for (k, _), ids in whole.items()) == want
    assert packing.pack(empty, subwords.vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, subwords.vocabulary_path(), longest=1000)


def test_language(docs, rows, empty):
    net = langid.train(docs, F.col("doc_id") % 4 != 2, epochs=12)
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (202, 203, 204, 205))
    held = [(i, lang) for i, t, lang, *_ in rows if i is not None and i < 100 and i % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(empty, F.lit(True)) is None and langid.identify(empty, net).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_sample_holds_rare_languages(spark):
    data = [(i, f"{lang} {i}", lang) for lang, n, first in (("a", 3000, 0), ("b", 3000, 3000), ("c", 3000, 6000), ("d", 30, 9000), ("e", 4, 9100)) for i in range(first, first + n)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert langid.train(table, F.lit(True), sample_rows=100, epochs=1).labels == list("abcde")
    chosen = langid.sample(table, F.lit(True), "text", "lang", "doc_id", 100).collect()
    assert collections.Counter(r.lang for r in chosen) == dict(zip("abcde", (24, 24, 24, 24, 4)))
    assert langid.places({"x": 1000, "y": 3, "z": 10}, 60) == {"y": 3, "z": 10, "x": 47}
    with pytest.raises(ValueError):
        langid.train(table, F.lit(True), sample_rows=4)


def test_quality(spark, docs, empty):
    r = random.Random(1)
    data = [(i, make_text(r, "en", 30) if i % 2 else " ".join(["spam!!", "BUY"] * 15)) for i in range(80)] + [(90, None), (91, ""), (None, "x")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(90, None), (3, 1)], "doc_id long, quality int")
    model = quality.train(table, labels, F.col("doc_id") % 4 < 2)
    got = {x.doc_id: x for x in quality.score(table, model).collect()}
    assert all(got[i].predicted == i % 2 and 0 <= got[i].score <= 1 for i in range(80)) and got[90].score == got[91].score
    flat = quality.train(table, labels.where("false"), F.lit(True))
    assert {x.score for x in quality.score(table, flat).collect()} == {0.5} and quality.score(empty, model).count() == 0


@pytest.mark.parametrize("known", [200_000, 8])
def test_language_model(docs, rows, empty, known):
    learn = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    vocabulary = lm.count_words(docs, learn, head=6, known=known)
    model = lm.fit(docs, learn, vocabulary, rounds=1)
    got = lm.score(docs, model, vocabulary).collect()
    split = [(i, lm.split(t) + [b""]) for i, t, *_ in rows]
    c = collections.Counter(w for i, ws in split if i is not None and i % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in split)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    none = lm.count_words(empty, F.lit(True))
    assert {(r.base_score, r.score) for r in lm.score(docs, lm.fit(empty, F.lit(True), none), none).collect()} == {(0.0, 0.0)}
    assert lm.score(empty, model, vocabulary).count() == 0


def test_language_model_learns_from_every_text(spark):
    for key in (0, 1, 2, 3, None):
        one = spark.createDataFrame([(key, "a b a c")], "doc_id long, text string")
        vocabulary = lm.count_words(one, F.lit(True))
        start, model = lm.new_model(vocabulary, 16), lm.fit(one, F.lit(True), vocabulary, rounds=3)
        assert any((model.weights[k] != w).any() for k, w in start.weights.items()), key


def test_mixing(docs, rows, empty):
    weights = {"s0": 5.0, "s1": 1.0, "s2": 2.0, "": 1.0, "absent": 3.0}
    got = mixing.mix(docs, weights, block_rows=4, frame=24).collect()
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((i, s or "") for i, _, _, s, *_ in rows)
    slots = mixing.quotas(weights, 24)
    frame = mixing.pfair_frame(slots)
    for r in got:
        assert frame[r.slot % 24][0] == r.source and r.release <= r.slot < r.deadline
        assert frame[r.slot % 24][1] == r.block % slots[r.source]
    for s in ("s0", "s1", "s2", ""):
        places = sorted((r.block, r.place) for r in got if r.source == s)
        assert places == [divmod(k, 4) for k in range(len(places))]
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1.0})
    assert mixing.mix(empty, {}).count() == 0 and mixing.in_mixed_order(docs, mixing.mix(docs, weights)).columns == docs.columns


def test_mixing_keeps_small_weights_over_the_whole_run(spark):
    weights = {"big": 0.2, "tiny": 0.0001, **{f"s{i:02}": 0.7999 / 19 for i in range(19)}}
    table = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id < 1800 THEN 'big' WHEN id < 1802 THEN 'tiny' ELSE format_string('s%02d', id % 19) END AS source")
    got = mixing.mix(table, weights, block_rows=1).collect()
    assert len(got) == len({r.doc_id for r in got}) == 9000 and len({r.slot for r in got}) == 9000
    total = sum(weights.values())
    for r in got:
        share = weights[r.source] / total
        assert r.release <= r.slot < r.deadline and abs(r.slot * share - r.block) <= 1 + 1e-6
    assert mixing.quotas(weights, 1000)["big"] == 200 and max(r.slot for r in got if r.source == "tiny") >= 10_000
    many = mixing.schedule(mixing.shares({f"s{i:04}": 1.0 + i % 2 for i in range(2000)}))
    count = collections.Counter(next(many)[1] for _ in range(3000))
    assert all(count[f"s{i:04}"] == 1 + i % 2 for i in range(2000))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8))
    x[60:100] = x[:40] + rng.normal(0, 0.12, (40, 8))
    x[100:] = x[5]
    data = [(i, v.tolist(), i % 2 if i < 100 else 1) for i, v in enumerate(x)]
    data += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, x[5].tolist(), None), (205, [], 1), (None, x[5].tolist(), 1), (206, [1.0], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embed.near_vectors(table, block_rows=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([d[2] for d in data[:120]])
    linked = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    low = np.arange(120)
    while True:
        new = np.minimum(low, np.where(linked, low, 999).min(1))
        if (new == low).all():
            break
        low = new
    for i in range(120):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), low[i], low[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 207))
    assert embed.near_vectors(table.where("false")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {a: find(a) for a in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pipeline_stages(spark, docs, rows, empty):
    """Every stage against its brute-force version, on what its predecessor kept."""
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    now, before = table, None
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.collect()]
        new = store.staged(stage(spark, now, ""), name)
        got = [tuple(r) for r in new.collect()]
        if name == "language":
            network = langid.train(now, F.lit(True))
            labelled = {(i, t): langid.label_texts(network, [t.encode()]).max() for i, t, *_ in before if t and re.search(r"[^\W\d_]", t)}
            want = [r for r in before if labelled.get(r[:2], 0) >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
            assert collections.Counter(got) == collections.Counter(want) and not {202, 203, 204, 205} & {r[0] for r in got}
        elif name == "exact_copies":
            top = {}
            for i, t, *_ in before:
                top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
            assert collections.Counter((t or "", -1 if i is None else i) for i, t, *_ in got) == collections.Counter(top.items())
        elif name == "near_copies":
            sets = {r[0]: shingles(r[1]) for r in before}
            low = {i: min(j for j in sets if j == i or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
            assert all(low[low[i]] == low[i] for i in sets)  # the fixture holds no chains, so groups are what each text is near
            assert sorted(r[0] for r in got) == sorted(i for i in sets if low[i] == i)
        elif name == "mix":
            assert collections.Counter(got) == collections.Counter(before)
            slots = mixing.mix(now, mixing.size_weights(now, corpus_pipeline.SIZE_POWER)).collect()
            assert [r.doc_id for r in stage(spark, now, "").collect()] == [r.doc_id for r in sorted(slots, key=lambda r: (r.slot, r.place))]
        else:
            coder = subwords.encoder(subwords.vocabulary_path())
            pieces = [(i, n) for i, t, *_ in before for n in packing.pieces(len(coder.encode(t)) // 4 + 1, 1024)]
            assert collections.Counter((r.doc_id, r.length) for r in new.collect()) == collections.Counter(pieces)
        assert name == "pack" or new.columns == table.columns
        now = new
    small = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, small, "").count() == 0


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({c: chr(c + 32) for c in range(65, 91)})))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_similar_copies_by_brute_force(spark, monkeypatch):
    """Groups of Jaccard similarity 0.8 and more over five-word shingles, split buckets included."""
    r = random.Random(11)
    monkeypatch.setattr(similar, "CELL", 8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(80, 160))) for _ in range(30)]
    data = [(i, t) for i, t in enumerate(base)]
    for i in range(90):
        words = base[r.choice((0, 0, 1, *range(30)))].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        data.append((100 + i, " ".join(words)))
    data += [(300, None), (301, ""), (302, " "), (303, "a b"), (304, "A B"), (None, base[2]), (3, base[3]), (305, base[4].upper())]
    sets = {i: shingles(t) for i, t in data if i is not None}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    empty_ones = {300, 301}  # equal once null is empty
    want = {i for i in sets if find(i) == i} - {max(empty_ones)}
    table = spark.createDataFrame([(*x, "x", "x", 0) for x in data], "doc_id long, text string, mark string, id string, code long").repartition(5)
    kept = similar.drop_similar(table)
    assert kept.columns == table.columns
    got = collections.Counter(x.doc_id for x in kept.collect())
    assert got.pop(None) == 1 and got.pop(3) == 2 and set(got) | {3} == want
    assert similar.drop_similar(table.where("false")).count() == 0


def plain_score(model, ids):
    """Natural log of a sequence, one number at a time."""
    w, size = {k: v.astype(float) for k, v in model.weights.items()}, model.size
    soft = lambda x: x / (1 + abs(x))
    h, before, out = np.zeros(size), model.end, 0.0
    for t in ids:
        x, u = w["table"][:, before], w["inner"] @ h
        gates = 0.5 + 0.5 * soft(x[: 2 * size] + u[: 2 * size])
        new = soft(x[2 * size :] + u[2 * size :] * gates[size:])
        h = gates[:size] * h + (1 - gates[:size]) * new
        share = lambda z: np.exp(z) / np.exp(z).sum()
        group = int(model.group[t])
        out += math.log(share(w["classes"] @ h + w["class_bias"][:, 0])[group])
        if t < model.n:
            s, e = model.edges[group], model.edges[group + 1]
            out += math.log(share(w["words"][s:e] @ h + w["word_bias"][s:e, 0])[t - s])
        before = t
    return out


def test_language_model_scores_by_the_book(docs, rows):
    learn = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    vocabulary = lm.count_words(docs, learn, head=9)
    model = lm.fit(docs, learn, vocabulary, rounds=2)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, model, vocabulary).collect()}
    place = {w: i for i, w in enumerate(vocabulary.head)}
    others, types = vocabulary.tokens - vocabulary.head_tokens, vocabulary.distinct - len(vocabulary.head)
    for i, text, *_ in rows[:60:7] + [r for r in rows if r[0] in (202, 203, 205)]:
        words = [*lm.split(text), lm.END]
        tail = sum(math.log10((vocabulary.known.get(w, 0) + 0.1) / (others + 0.1 * (types + 1))) for w in words if w not in place)
        want = plain_score(model, [place.get(w, model.n) for w in words]) / math.log(10) + tail
        assert abs(got[i, len(words)] - want) < 1e-3 * len(words)


def test_language_model_beats_single_words_on_unseen_texts(spark):
    r, ring = random.Random(6), [f"w{i}" for i in range(12)]
    data = []
    for i in range(600):
        at = r.randrange(12)
        data.append((i, " ".join(ring[(at + k) % 12] if r.random() < 0.9 else r.choice(ring) for k in range(30))))
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    learn = F.col("doc_id") % 5 != 0
    vocabulary = lm.count_words(table, learn)
    scores = lm.score(table.where(~learn), lm.fit(table, learn, vocabulary), vocabulary).collect()
    assert len(scores) == 120 and sum(x.score for x in scores) > sum(x.base_score for x in scores) + 100


def test_mixing_stays_within_a_block_of_uneven_targets():
    """Every source at every prefix of 100,000 slots, 1,500 sources of weights 1 to 1,500."""
    whole = mixing.shares({f"s{i}": float(i) for i in range(1, 1501)})
    total = sum(whole.values())
    worst, done = 0.0, dict.fromkeys(whole, 0)
    for t, name, block, release, deadline in mixing.schedule(whole):
        share = whole[name] / total
        assert release <= t < deadline and block == done[name]
        worst = max(worst, abs(t * share - block), abs((t + 1) * share - block - 1))  # a source strays most right before and after its slots
        done[name] += 1
        if t == 99_999:
            break
    assert worst < 1 and all(abs(done[n] - 100_000 * a / total) < 1 for n, a in whole.items())


def test_vectors_of_extreme_scale_keep_their_links(spark):
    table = spark.createDataFrame([(i, [s * x for x in (1.0, 2.0, 3.0)], 0) for i, s in enumerate((1.0, 1e200, 1e-200, 1e-310))], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embed.near_vectors(table).collect()} == {(3, 0)}
