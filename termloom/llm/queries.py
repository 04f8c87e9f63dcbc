"""One query for each training-data operator, with SQL where SQL can state the result."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embed, exact, langid, lm, mixing, packing, phrases, quality, secret_scan, simhash, substring, subwords, tokens
from .store import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(buckets: int, rest: int) -> Column:
    """Whether a document belongs to the fold that is never learned from; documents without an id do not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == rest, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, learn=~_held_out(4, 2))
    return quality.score(docs, model, threshold=0.7).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), width=50, texts=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), path, subwords.vocabulary_path(), end_id=2)
    return tokens.read_tokens(spark, path, ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.sorted_copies(_table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = langid.train(docs, learn=~_held_out(4, 2))
    return langid.identify(docs, network).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), subwords.vocabulary_path(), end_id=0, longest=1024, ids=False)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = _table(spark, sf_dir, "documents"), ~_held_out(10, 0)
    vocabulary = lm.count_words(docs, learn)
    model = lm.fit(docs, learn, vocabulary)
    scores = lm.score(docs, model, vocabulary)
    return scores.select("doc_id", _held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.size_weights(docs, power=0.7))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(_table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, share=50, most=2000)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_files": op3_token_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_vectors": op5_near_vectors,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_language_model": op9_language_model,
    "op10_mixing": op10_mixing,
    "op11_conversations": op11_conversations,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}


def _repair_sql() -> str:
    """The dynamic program of conversations.audits as a reduction of each conversation's rows: a list of the cheapest (cost, audit) of the
    four states; costs from 1000000 on are out of reach. DuckDB has no crc32: it is reduced from bits."""
    at = lambda q, cost, letter, b="a.b": f"{{'c': {b}[{q + 1}].c + {cost}, 'a': {b}[{q + 1}].a || '{letter}'}}"
    extra = "(CASE WHEN r.code BETWEEN 'A' AND 'Z' THEN 3 ELSE 0 END)"
    kept = lambda q, role: f"CASE WHEN lower(r.code) = '{role}' THEN {at(q, extra, 'K')} END"
    named = lambda q: f"CASE WHEN r.code <> 'd' THEN {at(q, f'3 + {extra}', 'R')} END"
    least = lambda *options: f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"
    after = [
        at(0, 4, "D"), least(at(1, 4, "D"), kept(0, "s")), least(at(2, 4, "D"), *[f(q) for q in (0, 1, 3) for f in (lambda q: kept(q, "u"), named)]),
        least(at(3, 4, "D"), kept(2, "a"), named(2)),
    ]
    put = lambda one, b: f"{{'c': {b}[{one}].c + 3, 'a': {b}[{one}].a || 'I'}}"
    second = lambda n: f"list_transform([{n}], lambda n: [n[1], n[2], {least('n[3]', put(1, 'n'), put(2, 'n'), put(4, 'n'))}, n[4]])[1]"
    both = lambda n: f"list_transform([{second(n)}], lambda m: [m[1], m[2], m[3], {least('m[4]', put(3, 'm'))}])[1]"
    far = "{'c': 1000000, 'a': ''}"
    return rf"""
        WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
        crc AS (
            SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS fault FROM keyed
        ), spoilt AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE fault <> 0
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM spoilt),
        judged AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                   CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed
        ), coded AS (
            SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE (CASE WHEN fault = 'truncated' THEN upper(x) ELSE x END) END AS code
            FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS x FROM judged)
        ), facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
                   list_reduce([{{'code': '', 'b': {both(f"[{{'c': 0, 'a': ''}}, {far}, {far}, {far}]")}}}] || list({{'code': code, 'b': [{far}]}} ORDER BY i),
                       lambda a, r: {{'code': '', 'b': {both("[" + ", ".join(after) + "]")}}}).b AS b
            FROM coded GROUP BY conv_id
        ), won AS (SELECT *, list_min([b[1], b[4]]) AS best FROM facts),
        letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS n FROM won WHERE best.a <> ''),
        counted AS (
            SELECT *, CASE WHEN letter <> 'I' THEN count(*) FILTER (WHERE letter <> 'I') OVER w END AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id) AS size
            FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY n)
        ), repaired AS (
            SELECT c.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY n)) AS digest
            FROM counted c LEFT JOIN placed p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i WHERE letter <> 'D' GROUP BY c.conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN won w ON o.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
    """


def _span_sql(rule: secret_scan.Rule, place: int) -> str:
    """(doc_id, start, place, kind, stop) of a rule's matches: the gaps between them, and they, add up to places."""
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]").replace("'", "''")
    whole = re.sub(r"\((?!\?)", "(?:", pattern)
    return f"""
        SELECT doc_id, start, {place} AS place, '{rule.kind}' AS kind, start + hit AS stop FROM (
            SELECT doc_id, judged, hit, CAST(sum(gap + hit) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - hit AS start FROM (
                SELECT doc_id, unnest(list_transform(string_split_regex(body, '{whole}')[1:-2], lambda g: length(g))) AS gap, unnest(list_transform(regexp_extract_all(body, '{pattern}', 0), lambda h: length(h))) AS hit,
                       unnest(regexp_extract_all(body, '{pattern}', {rule.group})) AS judged, unnest(generate_series(1, len(regexp_extract_all(body, '{pattern}', 0)))) AS i FROM d WHERE regexp_matches(body, '{pattern}')
            )
        ) WHERE length(judged) >= {rule.least}"""


ORACLES = {
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM starts),
        judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM windows),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM judged WHERE first < doc_id),
        cut AS (SELECT doc_id, count(*) AS n, list(pos) AS places FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ')
                      ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
        FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_near_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
        FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
        sized AS (SELECT lang, words, unnest([1, 2, 3]) AS size FROM w),
        runs AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase FROM sized WHERE len(words) >= size),
        f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS t, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        judged AS (
            SELECT c.lang, c.phrase, c.size, a, x.f AS l, y.f AS r, k, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(t[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(t[k + 1:], ' ')
        ), scored AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, part, max(a) AS top FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM scored WHERE size = 3) GROUP BY ALL
        ), kept AS (SELECT s.* FROM scored s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.part WHERE top IS NULL OR 100 * top < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op11_conversations": _repair_sql(),
    "op12_secrets": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        found AS ({" UNION ALL ".join(_span_sql(r, n) for n, r in enumerate(secret_scan.BASE + secret_scan.MORE))}),
        lines AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                   string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place) AS spans
            FROM found GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN lines ON d.doc_id = lines.doc_id
    """,
}
