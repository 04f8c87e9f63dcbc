"""Co-occurrences, specificity, and term graphs.

Pairs are (a, b, weight); graphs are edges (s, t, w) with s < t.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .metrics import substitute
from .pairs import CELLS, SCHEMA
from .pairs import cells as in_cells
from .pairs import counts as cell_pairs
from .storage import checkpointed, discard, ranked, staged, staged_at


CELL = 2048  # terms of a block at most
MOST_ROWS = 32_000_000  # terms in documents of a corpus whose cells are not split
MOST_TASKS = 1000  # that count cells, where shuffle partitions are fewer
MOST_SENT = 200_000  # terms that go to every task
FEW_PAIRS = 2_000_000  # pairs of terms that a task can count in memory


def cooccurrences(terms: DataFrame, members: DataFrame | None = None, groups: DataFrame | None = None, stop: DataFrame | None = None, threshold: int = 3, diagonal: bool = True, half: bool = True, by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """(*by, a, b, weight): documents with both terms, in their main forms (H1, H2, H3).

    The lists apply before terms are paired, so that a document's pairs are of listed terms only, and so does the threshold: the terms
    of a pair in so many documents are each in so many. Documents' terms are written once and numbered in order of (*by, term). A
    document's numbers are one array, cut into blocks of at most CELL numbers; each two of its blocks go where all documents' terms of
    these two blocks are, and are counted there in a matrix, so that no pair of a document is ever a row. Where all possible pairs are few,
    every task counts them where its documents are. ``half`` keeps a <= b, or a < b without the ``diagonal``.
    """
    forms = substitute(terms, groups)
    if members is not None:
        forms = forms.join(members.select("term").distinct(), "term", "left_semi")
    if stop is not None:
        forms = forms.join(stop.select("term").distinct(), "term", "left_anti")
    known = F.col("doc_id").isNotNull() & F.col("term").isNotNull()
    docs = staged(forms.select(*by, "doc_id", "term").where(known).distinct())
    often = docs.groupBy(*by, "term").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    ids = ranked(often, *by, "term", name="id")
    sizes = checkpointed(ids.groupBy(*by).agg(F.count("*").alias("terms"), F.min("id").alias("first"), F.sum("n").alias("rows")))
    n, pairs = sizes.agg(F.sum("terms"), F.sum(F.col("terms") * (F.col("terms") + 1) / 2)).first()
    sent = F.broadcast if (n or 0) <= MOST_SENT else lambda df: df
    if threshold > 1:
        docs = docs.join(sent(ids.select(*by, "term")), [*by, "term"], "left_semi")
    numbered = docs.join(sent(ids.select(*by, "term", "id")), [*by, "term"]).select(*by, "doc_id", "id").repartition(*by, "doc_id")
    arrays = numbered.groupBy(*by, "doc_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    out = _pair_counts(arrays, ids, sizes, pairs, sent, threshold, diagonal, by)
    return out if half else mirrored(out, by)


def numbered_cooccurrences(docs: DataFrame, ids: DataFrame, threshold: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, a, b, weight), a <= b, of documents given as one row (*by, doc_id, ids) each, whose distinct numbers stand for the (*by, term, id) of
    ``ids``, numbered in order of ``by``. ``docs`` is read more than once."""
    sizes = checkpointed(ids.groupBy(*by).agg(F.count("*").alias("terms"), F.min("id").alias("first")))
    n, pairs = sizes.agg(F.sum("terms"), F.sum(F.col("terms") * (F.col("terms") + 1) / 2)).first()
    if (pairs or 0) > FEW_PAIRS:
        rows = docs.groupBy(*by).agg(F.sum(F.size("ids")).alias("rows"))
        sizes = checkpointed(sizes.join(rows, list(by)) if by else sizes.crossJoin(rows))
    return _pair_counts(docs, ids, sizes, pairs, F.broadcast if (n or 0) <= MOST_SENT else lambda df: df, threshold, True, by)


def _pair_counts(arrays: DataFrame, ids: DataFrame, sizes: DataFrame, pairs: float, sent: Callable, threshold: int, diagonal: bool, by: tuple[str, ...]) -> DataFrame:
    """The second half of ``cooccurrences``: pairs of the numbers in documents' arrays, counted and named."""
    if (pairs or 0) <= FEW_PAIRS:
        each = arrays.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).where("a <= b" if diagonal else "a < b")
        counts = each.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= threshold)
    else:
        counts = _cell_counts(arrays, sizes, threshold, diagonal, by)
    named = lambda c, *more: sent(ids.select(F.col("id").alias(c), *more, F.col("term").alias(f"term_{c}")))
    return counts.join(named("a", *by), "a").join(named("b"), "b").select(*by, F.col("term_a").alias("a"), F.col("term_b").alias("b"), "weight")


def _cell_counts(arrays: DataFrame, sizes: DataFrame, threshold: int, diagonal: bool, by: tuple[str, ...]) -> DataFrame:
    """(a, b, weight) of documents' numbers, by cells of two blocks of a corpus's numbers. A cell's documents are in one task, so that its
    counts are final there; only those of a corpus of more than MOST_ROWS rows are dealt over several tasks, whose counts are added up."""
    spark = arrays.sparkSession
    blocks = F.ceil(F.col("terms") / CELL)
    parts = F.ceil(F.greatest(F.col("rows"), F.lit(1)) / MOST_ROWS)
    shares = sizes.select(*by, "first", F.ceil(F.col("terms") / blocks).alias("width"), blocks.alias("blocks"), parts.alias("parts"))
    tasks = shares.groupBy((F.col("parts") > 1).alias("split")).agg(F.sum(F.col("parts") * F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long").alias("cells"))
    most = max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = {r.split: min(2 * r.cells, most) for r in tasks.collect()}  # two a cell, so that few tasks have several
    if len(tasks) > 1:
        arrays = staged(arrays)
    found = []
    for split, n in tasks.items():
        some = F.broadcast(shares.where((F.col("parts") > 1) == split))
        shared = arrays.join(some, list(by)) if by else arrays.crossJoin(some)
        cells = shared.select("first", "width", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), "ids").mapInArrow(in_cells, CELLS)
        dealt = cells.repartition(n, "first", "i", "j", "part").sortWithinPartitions("first", "i", "j").select("first", "i", "j", "width", "left", "right")
        least = 1 if split else threshold
        counted = dealt.mapInArrow(lambda batches, least=least: cell_pairs(batches, least, diagonal), SCHEMA)
        found.append(counted.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= threshold) if split else counted)
    return reduce(DataFrame.unionAll, found)


def touching(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs with at least one of the terms."""
    known = lambda c: terms.select(F.col("term").alias(c), F.lit(True).alias(f"has_{c}"))
    return pairs.join(known("a"), "a", "left").join(known("b"), "b", "left").where("has_a OR has_b").select("a", "b", "weight")


def field_cooccurrences(docs: DataFrame, field: str, terms: DataFrame, threshold: int = 3) -> DataFrame:
    """(value, term, weight): documents with a field's value and a term (H4). Terms are dealt by document once, for both steps."""
    here = terms.select("doc_id", "term").repartition("doc_id").distinct()
    rows = docs.select("doc_id", F.col(field).alias("value")).join(here, "doc_id")
    return rows.groupBy("value", "term").agg(F.count("*").alias("weight")).where(F.col("weight") >= threshold)


def mirrored(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both orders of every pair, the diagonal once."""
    return pairs.select(*by, "a", "b", "weight").unionAll(pairs.where("a <> b").select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def specificity(pairs: DataFrame, mode: str = "full") -> DataFrame:
    """(term, gen, spec, specclusion, genclusion), rounded to 3 places (H5).

    P(i, j) = N(i, j) / N(j, j); gen sums a row, spec a column. "full" mirrors pairs given once; "triangular" takes them
    as they are, a the column and b the row.
    """
    if mode not in ("full", "triangular"):
        raise ValueError("mode is full or triangular")
    diagonal = pairs.where("a = b").select(F.col("a").alias("j"), F.col("weight").alias("n"))
    rows = mirrored(pairs).select(F.col("a").alias("i"), F.col("b").alias("j"), "weight") if mode == "full" else pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight")
    rows = rows.join(diagonal.select(F.col("j").alias("i")), "i", "left_semi")
    p = rows.join(diagonal, "j").select("i", "j", F.try_divide("weight", "n").alias("p"))
    both = p.select(F.col("i").alias("term"), F.col("p").alias("gen"), F.lit(0.0).alias("spec")).unionAll(p.select("j", F.lit(0.0), "p"))
    sums = both.groupBy("term").agg(F.sum("gen").alias("gen"), F.sum("spec").alias("spec"))
    three = lambda c: F.round(c, 3)
    return sums.select("term", three(F.col("gen")).alias("gen"), three(F.col("spec")).alias("spec"), three(F.col("spec") - F.col("gen")).alias("specclusion"), three(F.col("spec") + F.col("gen")).alias("genclusion"))


def min_max(directed: DataFrame, vertices: DataFrame, source: str = "s", target: str = "t") -> DataFrame:
    """One row ``threshold``: the smallest over all targets of the largest incoming weight, 0 without one (H9)."""
    top = directed.groupBy(F.col(target).alias("v")).agg(F.max("w").alias("top"))
    return vertices.select("v").join(top, "v", "left").agg(F.min(F.greatest(F.lit(0.0), F.coalesce("top", F.lit(0.0)))).alias("threshold"))


def row_sums(full: DataFrame) -> DataFrame:
    return full.groupBy(F.col("a").alias("v")).agg(F.sum("weight").cast("double").alias("sum"))


def conditional_graph(pairs: DataFrame) -> DataFrame:
    """(s, t, w): link {i < j} weighs c / s_j where that reaches the smallest of the rows' largest weights, else c / s_i
    where that does (H6). ``pairs`` has a < b."""
    full = checkpointed(mirrored(pairs.where("a <> b")))
    sums = row_sums(full)
    p = full.join(sums, full["a"] == sums["v"]).select("a", "b", (F.col("weight") / F.col("sum")).alias("w"))
    least = p.groupBy("a").agg(F.max("w").alias("top")).agg(F.min("top").alias("threshold"))
    kept = p.crossJoin(F.broadcast(least)).where("w >= threshold")
    sides = kept.groupBy(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t")).agg(F.max(F.when(F.col("a") > F.col("b"), F.col("w"))).alias("late"), F.max(F.when(F.col("a") < F.col("b"), F.col("w"))).alias("early"))
    return sides.select("s", "t", F.coalesce("late", "early").alias("w"))


def _stronger(r: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges i -> j whose weight passes the threshold of H9 and that of j -> i, as (s, t, w) with s < t."""
    back = r.select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("w").alias("back"))
    kept = r.join(back, ["s", "t"], "left").crossJoin(F.broadcast(min_max(r, vertices))).where((F.col("w") > F.col("threshold")) & (F.col("w") > F.coalesce("back", F.lit(0.0))))
    return kept.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "w")


HUB = 1000  # neighbours whose pairs one task makes


def _by_neighbour(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` and ``right`` with the same neighbour k; the many pairs of a hub are dealt over several tasks."""
    pieces = right.groupBy("k").agg(F.ceil(F.count("*") / HUB).cast("int").alias("pieces"))
    mine = left.join(pieces, "k").withColumn("piece", F.pmod(F.xxhash64("s"), "pieces").cast("int")).drop("pieces")
    every = right.join(pieces, "k").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    return mine.join(every, ["k", "piece"])


def _products(left: DataFrame, right: DataFrame, term: Column, bounds: DataFrame, weigh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(s, t, w) of the pairs that may pass the threshold of H9: ``weigh`` of (s, t, value), the sum of ``term`` over the common
    neighbours k of ``left`` (k, s, x) and ``right`` (k, t, y).

    ``bounds`` is (v, need, reach), such that a weight from s to t is at most reach(t) / need(s). The threshold is the smallest over all
    vertices of the largest incoming weight, so it is at least the smallest over all vertices of one incoming weight each: these few,
    from the vertex with a common neighbour that needs least, are summed first. Pairs that cannot come up to that are then left out before they are summed;
    none of them passes the threshold, holds a vertex's largest weight, or beats one that passes.
    """
    needy = left.join(bounds.select(F.col("v").alias("s"), "need"), "s")
    lowest = needy.groupBy("k").agg(F.min(F.struct("need", "s")).alias("one"))
    second = needy.join(lowest, "k").where(F.col("s") != F.col("one.s")).groupBy("k").agg(F.min(F.struct("need", "s")).alias("two"))
    other = F.when(F.col("one.s") != F.col("t"), F.col("one")).otherwise(F.col("two"))
    chosen = right.select("k", "t").join(lowest.join(second, "k", "left"), "k").groupBy("t").agg(F.min(other).alias("s")).select("t", "s.s")
    first = left.join(chosen, "s").join(right, ["k", "t"]).where("s <> t").groupBy("s", "t").agg(F.sum(term).alias("value"))
    least = bounds.select(F.col("v").alias("t")).join(chosen, "t", "left").join(weigh(first), ["s", "t"], "left").agg(F.min(F.coalesce("w", F.lit(0.0)))).first()[0] or 0.0
    able = right.join(bounds.select(F.col("v").alias("t"), "reach"), "t")
    pairs = _by_neighbour(needy, able).where((F.col("s") != F.col("t")) & (F.col("reach") >= F.col("need") * (least * (1 - 1e-9))))
    return weigh(pairs.groupBy("s", "t").agg(F.sum(term).alias("value")))


def cosine_graph(pairs: DataFrame, true_cosine: bool = False) -> DataFrame:
    """(s, t, w): sum over k of c_ik c_jk over A_ij = s_i - c_ij, or over sqrt(A_ij A_ji) for a ``true_cosine`` (H7).

    The sum is at most the product of both norms, and c_ij at most the largest of row i, which bounds a pair's weight (_products).
    """
    full = checkpointed(mirrored(pairs.where("a <> b")))
    sums = row_sums(full)
    k = full.select(F.col("b").alias("k"), F.col("a").alias("s"), F.col("weight").alias("x"))
    c = full.select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("weight").alias("c"))
    rows = full.groupBy(F.col("a").alias("v")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), (F.sum("weight") - F.max("weight")).cast("double").alias("rest"))
    rest = F.sqrt("rest") if true_cosine else F.col("rest")
    reach = F.coalesce(F.try_divide("norm", rest), F.lit(1e300)) if true_cosine else F.col("norm")
    bounds = checkpointed(rows.select("v", (rest / F.col("norm")).alias("need"), reach.alias("reach")))

    def weigh(dots: DataFrame) -> DataFrame:
        both = dots.join(c, ["s", "t"], "left").join(sums.select(F.col("v").alias("s"), F.col("sum").alias("si")), "s").join(sums.select(F.col("v").alias("t"), F.col("sum").alias("sj")), "t")
        c0 = F.coalesce("c", F.lit(0.0))
        below = F.sqrt((F.col("si") - c0) * (F.col("sj") - c0)) if true_cosine else F.col("si") - c0
        return both.select("s", "t", F.coalesce(F.try_divide(F.col("value").cast("double"), below), F.lit(0.0)).alias("w"))

    return _stronger(checkpointed(_products(k, k.select("k", F.col("s").alias("t"), F.col("x").alias("y")), F.col("x") * F.col("y"), bounds, weigh)), sums)


def distributional_graph(pairs: DataFrame) -> DataFrame:
    """(s, t, w): sum over k with mi_ik > 0 of min(mi_ik, mi_jk) over the sum of the same mi_ik, k neither i nor j, with
    mi = ln(c T / (s_i s_j)); a pair without counts has mi 0 (H8).

    The sum of least values is at most the sum of the positive mi of j, which bounds a pair's weight (_products).
    """
    full = checkpointed(mirrored(pairs.where("a <> b")))
    sums = row_sums(full)
    total = sums.agg(F.sum("sum").alias("T"))
    mi = full.join(sums.select(F.col("v").alias("a"), F.col("sum").alias("si")), "a").join(sums.select(F.col("v").alias("b"), F.col("sum").alias("sj")), "b").crossJoin(F.broadcast(total))
    mi = checkpointed(mi.select("a", "b", F.ln(F.col("weight") * F.col("T") / (F.col("si") * F.col("sj"))).alias("mi")))
    positive = mi.where("mi > 0")
    whole = positive.groupBy(F.col("a").alias("s")).agg(F.sum("mi").alias("whole"))
    left = positive.select(F.col("b").alias("k"), F.col("a").alias("s"), F.col("mi").alias("x"))
    right = mi.select(F.col("b").alias("k"), F.col("a").alias("t"), F.col("mi").alias("y"))
    own = positive.select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("mi").alias("own"))
    held = F.greatest("mi", F.lit(0.0))
    bounds = checkpointed(mi.groupBy(F.col("a").alias("v")).agg((F.sum(held) - F.max(held)).alias("need"), F.sum(held).alias("reach")))

    def weigh(overlap: DataFrame) -> DataFrame:
        below = F.col("whole") - F.coalesce("own", F.lit(0.0))
        return overlap.join(own, ["s", "t"], "left").join(whole, "s").select("s", "t", F.coalesce(F.try_divide("value", below), F.lit(0.0)).alias("w"))

    return _stronger(checkpointed(_products(left, right, F.least("x", "y"), bounds, weigh)), sums)


def node_weights(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, size): sum of the pair counts that touch a node of the graph."""
    ends = pairs.where("a <> b").select(F.col("a").alias("id"), "weight").unionAll(pairs.where("a <> b").select("b", "weight"))
    alive = edges.select(F.col("s").alias("id")).unionAll(edges.select("t")).distinct()
    return ends.groupBy("id").agg(F.sum("weight").alias("size")).join(alive, "id", "left_semi")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row ``modularity`` of (id, cluster): sum of in / m - (degree / 2m)^2."""
    c = lambda k: partition.select(F.col("id").alias(k), F.col("cluster").alias(f"c{k}"))
    rows = edges.join(c("s"), "s").join(c("t"), "t")
    inner = rows.where("cs = ct").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("inside"))
    degree = rows.select(F.col("cs").alias("c"), "w").unionAll(rows.select("ct", "w")).groupBy("c").agg(F.sum("w").alias("degree"))
    m = edges.agg(F.sum("w").alias("m"))
    parts = degree.join(inner, "c", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def _one_level(edges: DataFrame, least_gain: float, most_rounds: int) -> tuple[DataFrame, float | None]:
    """(id, cluster) after rounds of local moves, and the modularity before the last round; None without weight. In each round only the
    vertices of one half, by a hash of vertex and round, move, ties to the smallest cluster. The rounds end when no vertex of two
    halves in turn moves, or when four rounds together gain less than ``least_gain`` of modularity.

    A round is one job: clusters tell their totals to their vertices, these to their neighbours, and what a vertex hears is summed where the
    vertex is; the modularity of what the round starts from is observed on the way.
    """
    ends = edges.where("s <> t")
    spark = edges.sparkSession
    both, links = staged_at(ends.select(F.col("s").alias("v"), F.col("t").alias("u"), "w").unionAll(ends.select("t", "s", "w")))
    loops = edges.where("s = t").select(F.col("s").alias("v"), (2 * F.col("w")).alias("k"), (2 * F.col("w")).alias("loop"))
    degree = both.select("v", F.col("w").alias("k"), F.lit(0.0).alias("loop")).unionAll(loops).groupBy("v").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    seen = Observation()
    where, before = staged_at(degree.select("v", F.col("v").alias("c"), "k", "loop").observe(seen, F.sum("k").alias("doubled")))
    doubled = seen.get["doubled"] or 0.0
    if doubled == 0:
        return where.select(F.col("v").alias("id"), F.col("c").alias("cluster")), None
    still, scores, score = 0, [], None
    for turn in range(most_rounds):
        told = where.join(where.groupBy("c").agg(F.sum("k").alias("total")), "c")
        near = both.join(told.select(F.col("v").alias("u"), "c", "total"), "u").select("v", "c", "w", "total", F.lit(None).cast("double").alias("k"), F.lit(None).cast("double").alias("loop"))
        own = told.select("v", "c", F.lit(0.0).alias("w"), "total", "k", "loop")
        options = near.unionByName(own).repartition("v").groupBy("v", "c").agg(F.sum("w").alias("kc"), F.max("total").alias("total"), F.max("k").alias("mine"), F.max("loop").alias("loop"))
        options = options.withColumn("k", F.max("mine").over(Window.partitionBy("v")))
        here = F.col("mine").isNotNull()
        gain = F.round(F.col("kc") - (F.col("total") - F.when(here, F.col("k")).otherwise(F.lit(0.0))) * F.col("k") / doubled, 9)
        mine = lambda c: F.max(F.when(here, c))
        best = options.withColumn("gain", gain).groupBy("v").agg(
            mine(F.col("gain")).alias("here"), mine(F.col("c")).alias("own"), F.max("k").alias("k"), F.max("loop").alias("loop"), mine(F.col("kc")).alias("inside"), mine(F.col("total")).alias("total"),
            F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"),
        )
        moves = (-F.col("best.loss") > F.col("here")) & (F.pmod(F.xxhash64("v", F.lit(turn // 2)), F.lit(2)) == turn % 2)
        placed = best.withColumns({"c": F.when(moves, F.col("best.c")).otherwise(F.col("own")), "moved": moves})
        seen = Observation()
        now = F.sum(F.col("inside") + F.col("loop")) / doubled - F.sum(F.col("k") * F.col("total")) / doubled**2
        where, path = staged_at(placed.observe(seen, F.max("moved").alias("moved"), now.alias("score")).select("v", "c", "k", "loop"))
        discard(spark, before)
        before = path
        moved, score = seen.get["moved"], seen.get["score"]
        still = 0 if moved else still + 1
        if still == 2:
            break
        if turn % 4 == 0:
            scores.append(score)
            if len(scores) > 1 and scores[-1] - scores[-2] < least_gain:
                break
    else:
        raise RuntimeError("communities did not settle")
    discard(spark, links)
    return where.select(F.col("v").alias("id"), F.col("c").alias("cluster")), score


def community_levels(edges: DataFrame, least_gain: float = 1e-6, most_levels: int = 50, most_rounds: int = 200) -> list[DataFrame]:
    """The levels (id, cluster) of communities by local moves and contraction, until a level gains less than ``least_gain`` of
    modularity (H12); each level's ids are the clusters of the one before.

    Deterministic: the result does not depend on partitions. A cluster is named by one of its vertices. No levels without
    edges. Raises RuntimeError if the moves have not settled after ``most_levels`` levels of ``most_rounds`` rounds.
    """
    now = checkpointed(edges.select(F.col("s").cast("string").alias("s"), F.col("t").cast("string").alias("t"), F.col("w").cast("double").alias("w")))
    levels: list[DataFrame] = []
    score = None
    for _ in range(most_levels):
        level, new = _one_level(now, least_gain, most_rounds)
        if new is None or (score is not None and new - score < least_gain):
            return levels
        levels.append(level)
        score = new
        c = lambda k, level=level: level.select(F.col("id").alias(k), F.col("cluster").alias(f"c{k}"))
        joined = now.join(c("s"), "s", "left").join(c("t"), "t", "left").select(F.coalesce("cs", "s").alias("s"), F.coalesce("ct", "t").alias("t"), "w")
        now = staged(joined.groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.sum("w").alias("w")))
    raise RuntimeError("communities did not settle")


def dendrogram(levels: list[DataFrame]) -> DataFrame:
    """One written table (level, id, cluster): each vertex's community at every level, from 0, to choose from."""
    rows = [compose_levels(levels[: i + 1]).select(F.lit(i).alias("level"), "id", "cluster") for i in range(len(levels))]
    return staged(reduce(lambda a, b: a.unionByName(b), rows))


def compose_levels(levels: list[DataFrame]) -> DataFrame:
    """(id, cluster) of the last of several levels (H13). A cluster that a level has no row for, as one without links to others,
    keeps its name."""
    out = levels[0]
    for level in levels[1:]:
        further = level.select(F.col("id").alias("cluster"), F.col("cluster").alias("further"))
        out = out.join(further, "cluster", "left").select("id", F.coalesce("further", "cluster").alias("cluster"))
    return out


def communities(edges: DataFrame, **options) -> DataFrame:
    """(id, cluster): the communities of the last level (H12, community_levels); empty without edges."""
    levels = community_levels(edges, **options)
    return compose_levels(levels) if levels else edges.where("false").select(F.col("s").cast("string").alias("id"), F.col("t").cast("string").alias("cluster"))


def prune_bridges(edges: DataFrame, partition: DataFrame, bridgeness: float) -> DataFrame:
    """All links for b < 0; links within communities for b = 0; for b > 0 also the heaviest round(b links / (n1 + n2)) links of
    each pair of communities (H14)."""
    if bridgeness < 0:
        return edges
    c = lambda k: partition.select(F.col("id").alias(k), F.col("cluster").alias(f"c{k}"))
    rows = edges.join(c("s"), "s").join(c("t"), "t").select("s", "t", "w", F.least("cs", "ct").alias("c1"), F.greatest("cs", "ct").alias("c2"))
    inside = rows.where("c1 = c2").select("s", "t", "w")
    if bridgeness == 0:
        return inside
    size = partition.groupBy("cluster").agg(F.count("*").alias("n"))
    between = rows.where("c1 <> c2")
    quota = between.groupBy("c1", "c2").agg(F.count("*").alias("links")).join(size.select(F.col("cluster").alias("c1"), F.col("n").alias("n1")), "c1").join(size.select(F.col("cluster").alias("c2"), F.col("n").alias("n2")), "c2")
    quota = quota.select("c1", "c2", F.bround(F.lit(float(bridgeness)) * F.col("links") / (F.col("n1") + F.col("n2"))).alias("most"))
    placed = ranked(between, F.col("c1"), F.col("c2"), F.desc("w"), F.col("s"), F.col("t"))
    firsts = placed.groupBy("c1", "c2").agg(F.min("rank").alias("first"))
    return inside.unionByName(placed.join(quota, ["c1", "c2"]).join(firsts, ["c1", "c2"]).where("rank - first < most").select("s", "t", "w"))


def assemble(pairs: DataFrame, edges: DataFrame, partition: DataFrame, growth: DataFrame | None = None) -> DataFrame:
    """(id, label, size, cluster[, growth]) of the graph's nodes (H15); growth is shifted by 100."""
    nodes = node_weights(pairs, edges).join(partition, "id").select("id", F.col("id").alias("label"), "size", "cluster")
    return nodes if growth is None else nodes.join(growth.select(F.col("term").alias("id"), "growth"), "id", "left").withColumn("growth", F.coalesce("growth", F.lit(0.0)) + 100)


def preconditions(map_terms: DataFrame, docs: DataFrame, least: int = 50) -> DataFrame:
    """One row (n_terms, n_docs, enough)."""
    n = map_terms.agg(F.count("*").alias("n_terms"))
    return n.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs")))).withColumn("enough", (F.col("n_terms") >= least) & (F.col("n_docs") > 0))


def neighbourhood(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, touched, weight): neighbours of the chosen terms by how many of them they touch."""
    both = edges.select(F.col("s").alias("from"), F.col("t").alias("id"), "w").unionAll(edges.select("t", "s", "w"))
    pick = chosen.select(F.col("term").alias("from"))
    near = both.join(pick, "from", "left_semi").join(chosen.select(F.col("term").alias("id")), "id", "left_anti")
    return near.groupBy("id").agg(F.count("*").alias("touched"), F.sum("w").alias("weight")).orderBy(F.desc("touched"), F.desc("weight"), "id")


def graph_size(pairs: DataFrame, by: tuple[str, ...] = ("corpus_id",)) -> DataFrame:
    """(*by, n_terms): terms with more than one pair on their left side."""
    return pairs.where("weight >= 1").groupBy(*by, "a").agg(F.count("*").alias("n")).where("n > 1").groupBy(*by).agg(F.count("*").alias("n_terms"))
