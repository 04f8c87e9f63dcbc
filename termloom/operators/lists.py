"""Term lists, rankings, stop terms, synonym groups and the algebra of lists and matrices.

Lists are (term), weighted lists (term, weight), matrices (a, b, weight), translations (mainform, subform).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.sources.ingest import import_lists
from termloom.sources.ingest import new_terms as new_terms_of

from .documents import index_terms
from .metrics import substitute
from .storage import checkpointed, ranked, staged

# ---- joins and rankings


def with_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Members with their score, those without kept."""
    return members.join(scores, "term", "left")


def main_list(ranking: DataFrame, stop: DataFrame, hard_limit: int = 5000, ratio: float = 0.75, by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """Best ranked terms outside the stop list: at most ``hard_limit`` and ``ratio`` of the candidates."""
    free = ranking.join(stop.select("term"), "term", "left_anti")
    limit = free.groupBy(*by).agg(F.least(F.lit(hard_limit), F.bround(F.count("*") * ratio)).alias("most"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "term"))
    best = free.withColumn("place", place).where(F.col("place") <= hard_limit)  # a constant bound, so that ranks are pruned before the shuffle
    return best.join(limit, list(by)).where("place <= most").select(*by, "term", "score")


def map_list(scores: DataFrame, main: DataFrame, subforms: DataFrame, limit: int = 350, gen_part: float = 0.6, mono_part: float = 0.2) -> DataFrame:
    """(term, picked_by): quotas of single and multi-word terms by specclusion, then by genclusion among the rest.

    ``scores`` is (term, specclusion, genclusion) of one corpus. Every quota takes at least one term.
    """
    gen = round(limit * gen_part)
    spec = limit - gen
    quota = {("spec", True): round(spec * mono_part), ("gen", True): round(gen * mono_part)}
    quota |= {("spec", False): spec - quota["spec", True], ("gen", False): gen - quota["gen", True]}
    pool = scores.where("specclusion is not null and genclusion is not null").join(main.select("term"), "term", "left_semi")
    pool = pool.join(subforms.select(F.col("subform").alias("term")), "term", "left_anti")

    def best(rows: DataFrame, kind: str) -> DataFrame:
        parts = [rows.where(T.is_single(F.col("term")) == single).orderBy(F.desc(f"{kind}clusion"), "term").limit(max(1, quota[kind, single])) for single in (True, False)]
        return parts[0].unionByName(parts[1]).select("term", F.lit(kind).alias("picked_by"))

    first = best(pool, "spec")
    return first.unionByName(best(pool.join(first, "term", "left_anti"), "gen"))


def documents_for_terms(scores: DataFrame, members: DataFrame, limit: int = 5) -> DataFrame:
    """(doc_id, score, total): best documents by summed scores of the terms, and how many there are."""
    found = scores.join(members, "term", "left_semi").groupBy("doc_id").agg(F.sum("score").alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def paged_list(members: DataFrame, scores: DataFrame, groups: DataFrame, limit: int, offset: int) -> DataFrame:
    """Members and the sub forms of members with their scores, by falling score, the missing first, then by term."""
    subs = groups.join(members.select(F.col("term").alias("mainform")), "mainform", "left_semi").select(F.col("subform").alias("term"))
    every = members.select("term").union(subs).distinct()
    return with_scores(every, scores).orderBy(F.desc_nulls_first("score"), "term").offset(offset).limit(limit)


def duplicate_documents(docs: DataFrame, *fields: str, key: str = "doc_id") -> DataFrame:
    """(key, group_size, kept): documents with equal fields; the smallest key is kept."""
    signature = F.sha2(F.concat_ws("--", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    rows = docs.select(key, signature.alias("signature"))
    groups = rows.groupBy("signature").agg(F.count("*").alias("group_size"), F.min(key).alias("first"))
    return rows.join(groups, "signature").select(key, "group_size", (F.col(key) == F.col("first")).alias("kept"))


def equal_slices(rows: DataFrame, weight: str, *ties: str) -> DataFrame:
    """A column ``slice``: round(sqrt n) steps of equal size by rising weight."""
    n = rows.agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.round(F.col("n") / F.greatest(F.lit(1), F.round(F.sqrt("n")))))
    placed = ranked(rows.select(F.struct(*rows.columns).alias("row"), *[F.col(c).alias(f"o{i}") for i, c in enumerate((weight, *ties))]), *[F.col(f"o{i}") for i in range(1 + len(ties))])
    return placed.crossJoin(F.broadcast(n)).select("row.*", F.floor(F.col("rank") / size).alias("slice"))


def new_terms(tops: DataFrame) -> DataFrame:
    """(slice, term): terms of each slice that no earlier slice has."""
    return tops.groupBy("term").agg(F.min("slice").alias("slice")).select("slice", "term")


# ---- stop terms

# Patterns for the start of terms that carry no meaning in a scientific corpus, in the order of the rules.
STOP_STARTS = (
    r"^.{1,2}$", r"(.*)\d(.*)", r"(.*)(\,)(.*)", r"(.*)(< ?/?p ?>)(.*)", r"(.*)(result)(.*)", r"(.*)(year|année|nombre|moitié)(.*)", r"(.*)(temps)(.*)",
    r"(.*)(%)(.*)", r"(.*)(\{)(.*)", r"(.*)(terme)(.*)", r"(.*)(différent)(.*)", r"(.*)(travers)(.*)",
    r".*elsevier.*", r".*wiley.*", r".*springer.*", r".*university press.*",
    r"hypothes[ie]s$", r"analys[ie]s$", r"bas[ie]s$", r"online$", r"importance$", r"uses?$", r"cases?$", r"effects?$", r"times?$", r"methods?$",
    r"types?$", r"evidences?$", r"findings?$", r"relations?$", r"terms?$", r"procedures?$", r"factors?$", r"reports?$", r"changes?$", r"facts?$",
    r"others?$", r"applications?$", r"periods?$", r"investigations?$", r"orders?$", r"forms?$", r"conditions?$", r"situations?$", r"papers?$",
    r"relationships?$", r"values?$", r"areas?$", r"techniques?$", r"means?$", r"conclusions?$", r"comparisons?$", r"parts?$", r"amounts?$", r"aims?$",
    r"lacks?$", r"issues?$", r"ways?$", r"ranges?$", r"models?$", r"articles?$", r"series?$", r"totals?$", r"influences?$", r"journals?$", r"rules?$",
    r"persons?$", r"abstracts?$", r"(?:book)? reviews?$", r"process(?:es)?$", r"approach(?:es)?$", r"theor(?:y|ies)?$", r"methodolog(?:y|ies)?$",
    r"similarit(?:y|ies)?$", r"possibilit(?:y|ies)?$", r"stud(?:y|ies)?$",
    r"none$", r"other(?: hand)?$", r"whereas$", r"usually$", r"and$", r"eds?$", r"ltd$", r"copyright$", r"e-?mails?$", r".*=", r"=.*",
    r"further(?:more)?$", r"(.*)(:|\|)(.*)",
)


def stop_terms(terms: DataFrame, shared: DataFrame, starts: tuple[str, ...] = STOP_STARTS) -> DataFrame:
    """Distinct terms that are shared stop words or start like one (F1)."""
    distinct = terms.select("term").distinct()
    known = shared.select("term").distinct().withColumn("known", F.lit(True))
    return distinct.join(known, "term", "left").where(F.col("known") | F.col("term").rlike("^(?:" + "|".join(starts) + ")")).select("term")


# ---- synonym groups


def group_by_stem(terms: DataFrame, stop: DataFrame, key: Callable[..., Column] = T.stem_key, lang: str | None = None) -> DataFrame:
    """([lang, ]mainform, subform): per stem key the most frequent term leads the others (G1); ties to the smallest term. With a column
    ``lang`` the key is (lang, stem), and ``key`` takes the language too, as text.language_key does."""
    by = [lang] if lang else []
    stem = key(F.col("term"), *[F.col(c) for c in by])
    freq = terms.groupBy(*by, "term").agg(F.sum("weight").alias("freq")).join(stop.select("term"), "term", "left_anti").withColumn("key", stem)
    freq = checkpointed(freq)  # read twice; one row a term
    lead = freq.groupBy(*by, "key").agg(F.min(F.struct((-F.col("freq")).alias("less"), "term")).alias("lead")).select(*by, "key", F.col("lead.term").alias("mainform"))
    return freq.join(lead, [*by, "key"]).where("term <> mainform").select(*by, "mainform", F.col("term").alias("subform"))


def group_union(a: DataFrame, b: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(mainform, subform): both lists' links merged by connected components; the form with the most links out leads, ties
    to the smallest (G2). Smallest labels spread along links, twice as far each round, with a reliable checkpoint per round."""
    links = a.select("mainform", "subform").unionAll(b.select("mainform", "subform")).where("mainform <> subform")
    both = checkpointed(links.select(F.col("mainform").alias("v"), F.col("subform").alias("w")).unionAll(links.select("subform", "mainform")).distinct())
    labels = checkpointed(both.groupBy("v").agg(F.least("v", F.min("w")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        moved = labels.join(near, "v").select("v", F.least("label", "near").alias("label"))
        jump = moved.join(moved.select(F.col("v").alias("label"), F.col("label").alias("further")), "label")
        new = staged(jump.select("v", F.least("label", "further").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "v").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("groups did not settle")
    out = links.groupBy(F.col("mainform").alias("v")).agg(F.count("*").alias("out"))
    ranked = labels.join(out, "v", "left").select("v", "label", F.coalesce("out", F.lit(0)).alias("out"))
    top = ranked.groupBy("label").agg(F.max("out").alias("top"))
    lead = ranked.join(top, "label").where("out = top").groupBy("label").agg(F.min("v").alias("mainform"))
    return ranked.join(lead, "label").where("v <> mainform").select("mainform", F.col("v").alias("subform"))


def add_links(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Old links and those of ``new`` that are missing."""
    fresh = new.select("mainform", "subform").distinct().join(groups, ["mainform", "subform"], "left_anti")
    return groups.select("mainform", "subform").unionByName(fresh)


def remove_links(groups: DataFrame, gone: DataFrame) -> DataFrame:
    return groups.join(gone, ["mainform", "subform"], "left_anti")


def main_form(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, mainform): what each term stands under, itself without a link."""
    return terms.join(groups, terms["term"] == groups["subform"], "left").select("term", F.coalesce("mainform", "term").alias("mainform"))


# ---- algebra


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """I1"""
    return a.select("term").unionAll(b.select("term")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """I2, I6 with a plain list: rows of ``a`` whose term is not in ``b``."""
    return a.join(b.select("term"), "term", "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """I3"""
    return a.select("term").join(b.select("term"), "term", "left_semi").distinct()


def weigh(a: DataFrame) -> DataFrame:
    """A plain list with weight 1."""
    return a if "weight" in a.columns else a.select("term", F.lit(1.0).alias("weight"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of the weights of common terms."""
    return weigh(a).join(weigh(b).withColumnRenamed("weight", "other"), "term").select("term", (F.col("weight") * F.col("other")).alias("weight"))


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums over the union of the terms."""
    return weigh(a).select("term", "weight").unionByName(weigh(b).select("term", "weight")).groupBy("term").agg(F.sum("weight").alias("weight"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of the weights, exact zeros dropped; missing counts as zero."""
    return plus(a, b.select("term", (-F.col("weight")).alias("weight"))).where("weight <> 0")


def translate(a: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms in their main form: weights summed, plain lists distinct (I8)."""
    out = substitute(a, groups)
    return out.groupBy("term").agg(F.sum("weight").alias("weight")) if "weight" in a.columns else out.select("term").distinct()


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both translations in one, the right one winning, resolved one step, self links dropped."""
    both = b.select("mainform", "subform").unionByName(a.select("mainform", "subform").join(b.select("subform"), "subform", "left_anti").select("mainform", "subform"))
    further = both.select(F.col("subform").alias("mainform"), F.col("mainform").alias("target"))
    return both.join(further, "mainform", "left").select(F.coalesce("target", "mainform").alias("mainform"), "subform").where("mainform <> subform")


def matrix_plus(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Sum or difference on the pairs of the left matrix, zeros dropped."""
    joined = a.join(b.withColumnRenamed("weight", "other"), ["a", "b"], "left")
    return joined.select("a", "b", (F.col("weight") + sign * F.coalesce("other", F.lit(0.0))).alias("weight")).where("weight <> 0")


def matrix_without(m: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs that touch no term of the list."""
    t = terms.select("term")
    return m.join(t, m["a"] == t["term"], "left_anti").join(t, m["b"] == t["term"], "left_anti")


def matrix_inside(m: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs with both terms in the list."""
    t = terms.select("term")
    return m.join(t, m["a"] == t["term"], "left_semi").join(t, m["b"] == t["term"], "left_semi")


def matrix_translate(m: DataFrame, groups: DataFrame) -> DataFrame:
    """The second term in its main form, weights summed."""
    return m.join(groups, m["b"] == groups["subform"], "left").groupBy("a", F.coalesce("mainform", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def matrix_scale(m: DataFrame, weights: DataFrame, divide: bool = False) -> DataFrame:
    """Weights times, or over, sqrt(w_a w_b) for pairs inside the list."""
    left, right = (weights.select(F.col("term").alias(c), F.col("weight").alias(f"w_{c}")) for c in "ab")
    scale = F.sqrt(F.col("w_a") * F.col("w_b"))
    value = F.try_divide("weight", scale) if divide else F.col("weight") * scale
    return m.join(left, "a").join(right, "b").select("a", "b", value.alias("weight"))


# ---- life cycle

PRIORITY = {"stop": 1, "main": 2, "map": 3}


def merge_lists(old: DataFrame, new: DataFrame, groups: DataFrame, drop_old: tuple[str, ...] = ()) -> DataFrame:
    """(list_name, term): old and new lists merged; map wins over main over stop, sub forms follow their main form, and
    all of map is in main (J1)."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    rows = old.where(~F.col("list_name").isin(*drop_old)) if drop_old else old
    every = rows.select("list_name", "term").unionByName(new.select("list_name", "term"))
    best = every.groupBy("term").agg(F.max(rank[F.col("list_name")]).alias("rank"))
    lead = best.select(F.col("term").alias("mainform"), F.col("rank").alias("led"))
    subs = groups.join(lead, "mainform").groupBy("subform").agg(F.max("led").alias("led"))
    joined = best.join(subs, best["term"] == subs["subform"], "full").select(F.coalesce("term", "subform").alias("term"), F.coalesce("led", "rank").alias("rank"))
    names = F.when(F.col("rank") == 3, F.array(F.lit("map"), F.lit("main"))).when(F.col("rank") == 2, F.array(F.lit("main"))).otherwise(F.array(F.lit("stop")))
    return joined.select(F.explode(names).alias("list_name"), "term")


def import_and_merge(rows: DataFrame, clean: Callable[[Column], Column], old: DataFrame, groups: DataFrame, docs: DataFrame, text: Column, known: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists, groups and new index rows after a term list is imported (J2): the list is read (A18), its terms are looked for in the
    texts and indexed where the index lacks them (C3), and lists and groups are merged with the old ones (J1), or take their
    place with ``overwrite``."""
    lists, links = import_lists(rows, clean)
    every = links if overwrite else add_links(groups, links)
    merged = merge_lists(old.where("false") if overwrite else old, lists, every)
    wanted = lists.select("term").unionAll(links.select(F.col("subform").alias("term"))).distinct()
    return merged, every, index_terms(docs, text, wanted, known.select("doc_id", "term"))


def add_term(raw: DataFrame, clean: Callable[[Column], Column], dictionary: DataFrame, groups: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """(term, is_new, n_docs, occurrences, mainform): what becomes of each term given in ``raw`` (J11): normalised (B1, B3), new to the
    dictionary or not (A15), looked for in the texts (C3), with its counts and the form it stands under (G5)."""
    terms = raw.select(clean(F.col("term")).alias("term")).where("term <> ''").distinct()
    fresh = new_terms_of(terms, dictionary).withColumn("is_new", F.lit(True))
    counts = index_terms(docs, text, terms).groupBy("term").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("weight").alias("occurrences"))
    out = main_form(groups, terms).join(fresh, "term", "left").join(counts, "term", "left")
    return out.select("term", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("occurrences", F.lit(0.0)).alias("occurrences"), "mainform")


def list_family(main: DataFrame, map_: DataFrame, stop: DataFrame, groups: DataFrame) -> DataFrame:
    """(term, in_map, in_stop, subforms) of main, stop and their sub forms."""
    every = union(union(main, stop), groups.select(F.col("subform").alias("term")))
    flag = lambda df, name: df.select("term").distinct().withColumn(name, F.lit(True))
    subs = groups.groupBy(F.col("mainform").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("subform")), "|").alias("subforms"))
    out = every.join(flag(map_, "in_map"), "term", "left").join(flag(stop, "in_stop"), "term", "left").join(subs, "term", "left")
    return out.select("term", F.coalesce("in_map", F.lit(False)).alias("in_map"), F.coalesce("in_stop", F.lit(False)).alias("in_stop"), "subforms")


def corpus_list(lists: DataFrame, names: tuple[str, ...], groups: DataFrame, synonyms: bool = False) -> DataFrame:
    """(list_name, term) of the chosen lists without sub forms, or with those of their main forms; terms of map are not
    repeated under main (J7)."""
    subs = groups.select(F.col("subform").alias("term")).distinct()
    rows = lists.where(F.col("list_name").isin(*names)).select("list_name", "term").join(subs, "term", "left_anti").select("list_name", "term")
    if synonyms:
        rows = rows.unionByName(rows.join(groups, rows["term"] == groups["mainform"]).select("list_name", F.col("subform").alias("term"))).distinct()
    mapped = rows.where("list_name = 'map'").select("term")
    return rows.where("list_name <> 'main'").unionByName(rows.where("list_name = 'main'").join(mapped, "term", "left_anti").select("list_name", "term"))


def annotate(terms: DataFrame, lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, term, group, weight, list_name): a document's terms in each list through their main form; terms of map
    do not show under main (C8)."""
    led = terms.join(groups, terms["term"] == groups["subform"], "left").withColumn("form", F.coalesce("mainform", "term"))
    hit = led.join(lists.select(F.col("term").alias("form"), "list_name").distinct(), "form")
    mapped = lists.where("list_name = 'map'").select("term").distinct()
    main = hit.where("list_name = 'main'").join(mapped, "term", "left_anti")
    columns = ["doc_id", "term", F.col("mainform").alias("group"), "weight", "list_name"]
    return hit.where("list_name <> 'main'").select(*columns).unionByName(main.select(*columns))


def add_favorites(known: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Known favorites and the wanted ones, all of them or, if one is not in the corpus, none."""
    strange = wanted.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("strange"))
    fresh = wanted.select("doc_id").distinct().join(known, "doc_id", "left_anti").crossJoin(F.broadcast(strange)).where("strange = 0")
    return known.select("doc_id").unionByName(fresh.select("doc_id"))
