"""Conversation repair, secret scans and phrase mining on small tables, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import conversations as C
from termloom.llm import phrases as P
from termloom.llm import secret_scan as S

BLANKS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


# ---- conversations


def spoil(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        blank = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else blank(role), {1: "", 2: re.sub("[.!?]", "", blank(text))}.get(fault, blank(text))
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def fits(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None


def every_repair(rows):
    """(cost, audit, lines) of all edits of a few rows with at most two inserts, by trying them out."""
    seen, options = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANKS)
        gone, extra = not bare or (role, text) in seen, 3 * (bool(bare) and bare[-1] not in ".!?")
        seen.add((role, text))
        options.append([("D", 4, None)] + ([] if gone else [("K", extra, (role, text)), *[("R", 3 + extra, (n, text)) for n in NAMES.values()]]))
    inserts = [list(x) for n in range(3) for x in itertools.product(NAMES.values(), repeat=n)]
    gaps = range(len(rows) + 1)
    best = None
    for added in inserts:
        for spots in itertools.combinations_with_replacement(gaps, len(added)):
            for chosen in itertools.product(*options):
                steps, left = [], list(zip(spots, added))
                for i, step in enumerate([*chosen, None]):
                    while left and left[0][0] == i:
                        steps.append(("I", 3, (left.pop(0)[1], "")))
                    steps += [step] if step else []
                lines = [x[2] for x in steps if x[2]]
                if fits(role[:1] if role[:1] in tuple("sua") else "x" for role, _ in lines):
                    found = (sum(x[1] for x in steps), "".join(x[0] for x in steps), "\n".join(f"{r}:{t}" for r, t in lines))
                    best = found if best is None or found[:2] < best[:2] else best
    return best


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))


def check_report(got, rows):
    groups = collections.defaultdict(list)
    for r in spoil(rows):
        groups[r[0]].append(r)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        mine = in_order(groups[r.conv_id])
        turns = [t for _, t, _, _ in mine if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        blank = [not t.rstrip(BLANKS) for *_, t in mine]
        again = [not b and (role, t) in {x[2:] for x in mine[:i]} for i, (b, (_, _, role, t)) in enumerate(zip(blank, mine))]
        cut = [not b and not d and t.rstrip(BLANKS)[-1] not in ".!?" for b, d, (*_, t) in zip(blank, again, mine)]
        assert (r.blank, r.duplicate, r.truncated) == (sum(blank), sum(again), sum(cut))
        assert r.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = every_repair(mine)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, conv string, mark string, copies string"


def test_conversations(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No", "Why?", "", " \n", None, "Go on!"]), "x", "y", "z") for c in range(40) for t in range(r.randint(1, 5))]
    rows += [(None, None, "user", "a.", "x", "y", "z"), (None, 3, "assistant", "b.", "x", "y", "z"), (50, None, None, None, "x", "y", "z"), (51, 2, "user", "q?", "x", "y", "z"), (51, 2, "user", "q?", "x", "y", "z")]
    check_report(C.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), rows)
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversations_are_cut_and_joined(spark, monkeypatch):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", "Why?", "", f"{t}."]), "x", "y", "z") for c in range(3) for t in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {x.conv_id: x for x in C.repair_report(docs).collect()}
    monkeypatch.setattr(C, "PIECE_ROWS", 7)
    assert {x.conv_id: x for x in C.repair_report(docs.repartition(2)).collect()} == whole
    spoilt = C.damage(docs)
    text = C.repaired(spoilt, C.audits(spoilt))
    for c, group in itertools.groupby(sorted(text.collect(), key=lambda x: (x.conv, x.place)), key=lambda x: x.conv):
        lines = list(group)
        assert fits(x.role[:1] for x in lines) and [x.place for x in lines] == list(range(len(lines)))
        assert whole[c].repaired_sha256 == hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines).encode()).hexdigest()


def test_pieces_of_a_conversation_give_the_cheapest_least_audit():
    r = random.Random(9)
    for _ in range(300):
        rows = "".join(r.choice("suaxSUAXdd") for _ in range(r.randint(0, 12)))
        whole = C.joined(iter([{0: C.edits(rows, 0)}]))
        cut = sorted(r.randint(0, len(rows)) for _ in range(3))
        parts = [rows[a:b] for a, b in itertools.pairwise([0, *cut, len(rows)])]
        assert C.joined({s: C.edits(p, s) for s in range(4)} for p in parts) == whole


def test_trails_compare_like_strings(monkeypatch):
    for prime in (C.PRIME, 3):  # with a prime of 3 nearly all hashes are equal
        monkeypatch.setattr(C, "PRIME", prime)
        r, trails, text = random.Random(1), C.Trails(), {0: b""}
        for _ in range(400):
            node, piece = r.choice(list(text)), bytes(r.choice(b"KDI") for _ in range(r.randint(1, 4)))
            text[trails.add(node, piece)] = text[node] + piece
        for a, b in itertools.product(r.sample(list(text), 40), repeat=2):
            assert trails.less(a, b) == (text[a] < text[b]) and trails.letters(a) == text[a]


# ---- secrets

KEYS = ["password: hunter22", "API_KEY='abc123def'", "apikey=abc", "secret = s3cr3t/+=", "token=x token=abcdefg", "api_key=token:abcdefgh", "AKIA" + "Q7" * 8, "AKIA" + "Q" * 5,
        "0123456789abcdef" * 2, "deadbeef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "AIza" + "x_-9z" * 7, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "https://me:pw@host/x"]


def scan_text(text):
    found = []
    for place, rule in enumerate(S.BASE + S.MORE):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return sorted(found)


def test_secrets(spark):
    r = random.Random(4)
    word = lambda: r.choice(["pass", "der", "ébé", "\U0001f511", "tok", "face", "key", "\n", ":"])
    texts = [" ".join(r.choice([word(), word(), word(), r.choice(KEYS)]) for _ in range(r.randint(0, 30))) for _ in range(80)] + [None, "", " ".join(KEYS) * 400, "PassWord=ABCDEF", "ſecret=abcdefg"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, KEYS[0], "x", "y"), (None, KEYS[6], "x", "y"), (None, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, body string").repartition(3)
    got = collections.Counter(tuple(x) for x in S.scan(docs).collect())
    line = lambda found: ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    want = collections.Counter()
    for i, t, *_ in rows:
        found = scan_text(t or "")
        base = [x for x in found if x[1] < 3]
        want[i, *(sum(x[2] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(line(base).encode()).hexdigest(), line(found)] += 1
    assert got == want
    assert S.scan(docs.limit(0)).count() == 0


def test_trigram_queries():
    q = {r.kind: S.trigram_query(r.pattern) for r in S.BASE + S.MORE}
    assert frozenset() in q["hex"] and q["access"] == {frozenset({"aki", "kia"})} and len(q["assign"]) == 6
    assert S.trigram_query("ab?cd") == {frozenset({"abc", "bcd"}), frozenset({"acd"})}
    assert S.trigram_query("(?:abc)*x") == S.ALL and S.trigram_query("abc[a-z]+def") == {frozenset({"abc", "def"})}
    for key in KEYS:
        low = {key.lower()[i : i + 3] for i in range(len(key))}
        for rule in S.BASE + S.MORE:
            if re.search(rule.pattern, key):
                assert any(need <= low for need in q[rule.kind])


# ---- phrases


def count_phrases(rows, longest):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return n, f


def best_phrases(rows, longest, least, share, most):
    n, f = count_phrases(rows, longest)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= share * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(8)
    words = ["New", "york", "city", "the", "of", "état", "x y", "a", "b", "c"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x00 "]) for _ in range(n))
    rows = [(i, text(r.randint(0, 60)), r.choice(["en", "fr", None]), "x", "y") for i in range(120)]
    rows += [(i, "deep blue sea. deep blue sea", "en", "x", "y") for i in range(200, 207)] + [(7, None, "en", "x", "y"), (8, "", "de", "x", "y"), (None, text(400), None, "x", "y"), (9, text(9000), "en", "x", "y"), (9, "a b", "en", "x", "y")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, shard string").repartition(4)


@pytest.mark.parametrize("gate, keep, shards", [(25, 27, 4), (16, 16, 3), (25, 27, 1)])
def test_collocations(spark, talk, monkeypatch, gate, keep, shards):
    rows, docs = talk
    monkeypatch.setattr(P, "GATE_BITS", gate)
    monkeypatch.setattr(P, "KEEP_BITS", keep)
    got = sorted((tuple(x) for x in P.collocations(docs, longest=3, least=10, share=50, most=60, shards=shards).collect()), key=str)
    assert got == best_phrases(rows, 3, 10, 50, 60)
    assert P.collocations(docs.limit(0), shards=2).count() == 0


def test_counts_of_all_lengths(talk):
    rows, docs = talk
    n, f = count_phrases(rows, 2)
    got = {(x.lang, x.phrase): x.n for x in P.mine(docs, longest=2, least=5, shards=2).collect()}
    want = {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 5} | {(lang, ""): a for lang, a in n.items()}
    assert got == want


def test_a_phrase_counts_for_one_cycle_from_the_scan_after_its_parts():
    h = np.array([5, 9, 0, 7], np.uint64) << np.uint64(56)
    gates = [np.full(1 << P.GATE_BITS, P.NEVER, np.uint8) for _ in range(2)]
    for i, step in ((0, 0), (1, 2)):
        gates[0][P._slots(h[i : i + 1], P.GATE_BITS)] = step
    (_, ones, first1), (_, twos, first2), (_, threes, first3) = P.starts(h, 3, gates)
    assert ones.tolist() == [True, True, False, True] and set(first1) == {0}
    assert twos.tolist() == [True, False, False] and first2[0] == 3 and not threes.any() and min(first3) > P.NEVER


# ---- mended operators


def test_columns_of_any_name_pass_every_stage(spark):
    import corpus_pipeline
    from termloom.llm import store

    rows = [(i, f"the cat is with the dog number {i % 7} of all the cats and dogs", "en", f"s{i % 2}", 1, i, f"{i}") for i in range(20)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d e"]
    now = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = store.staged(stage(spark, now, ""), name)
        assert now.columns == names and all(r["a.b"] == r["doc_id"] and r["c`d e"] == str(r["doc_id"]) for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0


def test_mixing_of_sparse_sources_takes_no_time_for_empty_slots(spark):
    from termloom.llm import mixing

    whole = mixing.shares({"big": 1.0, "rare": 1e-6, "absent": 5.0})
    total, blocks = sum(whole.values()), {"big": 500, "rare": 1000}
    rows = list(mixing.filled(whole, blocks, 1000))
    assert collections.Counter(r[1] for r in rows) == blocks and [r[0] for r in rows] == sorted({r[0] for r in rows})
    assert all(release <= slot < deadline for slot, _, _, release, deadline in rows)
    assert all(abs(slot * whole[n] / total - j) <= 1 + 1e-6 for slot, n, j, _, _ in rows) and rows[-1][0] > 10**9
    table = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'big' ELSE 'rare' END AS source")
    assert mixing.mix(table, {"big": 1.0, "rare": 1e-6}, block_rows=1).count() == 4000


def test_slots_are_those_of_the_schedule_while_most_hold_blocks():
    from termloom.llm import mixing

    whole = mixing.shares({"a": 3.0, "b": 2.0, "c": 0.5})
    blocks = {"a": 60, "b": 50, "c": 12}
    want = [r for r in itertools.islice(mixing.schedule(whole), 400) if r[2] < blocks[r[1]]]
    assert list(mixing.filled(whole, blocks, 10)) == want


def test_language_network_learns_from_whole_texts(spark):
    from termloom.llm import langid

    tail = {"en": "the and of is with from " * 30, "fr": "les une dans être déjà où " * 30}
    rows = [(i, "12345 " * 400 + tail["en" if i % 2 else "fr"], "en" if i % 2 else "fr") for i in range(60)]  # only the ends tell
    network = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), epochs=8)
    assert [network.labels[langid.label_texts(network, [tail[k].encode()]).argmax()] for k in ("en", "fr")] == ["en", "fr"]


def test_pooled_probabilities_by_the_book():
    """Every window of a text by plain loops over bytes, averaged over all bytes."""
    from termloom.llm import langid

    network, text = langid.Network(["en", "fr"], 4, seed=3), "Où est-il ? Là-bas, dans l'été.".encode() * 3
    w, soft = network.weights, lambda x: x / (1 + np.abs(x))
    pooled = np.zeros(2)
    for at in range(0, len(text), 16):
        window = text[at : at + 16]

        def run(letters, side):
            h, out = np.zeros(4), []
            for b in letters:
                x, u = w[f"table{side}"][:, b].astype(float), w[f"inner{side}"].astype(float) @ h
                keep, reset = soft(x[:4] + u[:4]) / 2 + 0.5, soft(x[4:8] + u[4:8]) / 2 + 0.5
                h = keep * h + (1 - keep) * soft(x[8:] + reset * u[8:])
                out.append(h)
            return out

        for ahead, behind in zip(run(window, "f"), run(window[::-1], "b")[::-1]):
            z = w["outf"] @ ahead + w["outb"] @ behind + w["bias"][:, 0]
            pooled += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(langid.label_texts(network, [text], steps=16)[0], pooled / len(text), atol=1e-5)


def test_quality_training_by_the_book():
    """sgd against one step after another with the layer kept apart from the table."""
    from termloom.llm import quality

    rng = np.random.default_rng(5)
    bags = [(np.sort(rng.choice(40, n, replace=False)).astype(np.int32), np.full(n, 1 / n, np.float32)) for n in rng.integers(1, 9, 12)]
    truth = rng.integers(0, 2, 12)
    weights, bias = quality.sgd(bags, truth, dim=3, epochs=2, rate=0.5, seed=7)
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / 3, 1 / 3, (quality.BUCKETS, 3)).astype(np.float32).astype(float)
    layer, off, done = [[0.0] * 3, [0.0] * 3], [0.0, 0.0], 0
    for _ in range(2):
        for i in rng.permutation(12):
            rows, share = bags[i]
            mean = [sum(w * table[r, d] for r, w in zip(rows, share)) for d in range(3)]
            z = [sum(a * b for a, b in zip(layer[y], mean)) + off[y] for y in range(2)]
            p = [np.exp(x) / sum(np.exp(v) for v in z) - (y == truth[i]) for y, x in enumerate(z)]
            now = 1 - done / 24
            back = [sum(p[y] * layer[y][d] for y in range(2)) for d in range(3)]
            for y in range(2):
                off[y] -= 0.05 * now * p[y]
                for d in range(3):
                    layer[y][d] -= 0.5 * now * p[y] * mean[d]
            for r, w in zip(rows, share):
                table[r] -= [0.5 * now / sum(x * x for x in share) * w * b for b in back]
            done += 1
    used = sorted({r for rows, _ in bags for r in rows})
    want = [sum(table[r, d] * (layer[1][d] - layer[0][d]) for d in range(3)) for r in used]
    assert np.allclose(weights[used], want, atol=1e-5) and abs(bias - (off[1] - off[0])) < 1e-6


def test_quality_scores_by_the_book(spark):
    """The mean of the numbers of a text's features, text by text, through the logistic curve."""
    from termloom.llm import quality, spans

    rng = np.random.default_rng(2)
    model = rng.normal(0, 1, quality.BUCKETS).astype(np.float32), 0.25
    texts = ["one two two three", "", None, "Über große Straßen, hinüber", "x", "a b " * 500]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, threshold=0.5).collect()}
    for i, text in enumerate(texts):
        data, offsets = spans.flat(pa.array([text]))
        rows = [r for part, _ in quality.features(data, offsets) for r in part] if text else []
        want = 1 / (1 + np.exp(-(float(np.mean([float(model[0][r]) for r in rows])) if rows else 0.0) - 0.25))
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)
