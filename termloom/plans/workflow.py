"""The whole corpus workflow as one lazy plan, and its recount."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import graph as G
from termloom.operators import lists as L
from termloom.operators import metrics as M
from termloom.operators.storage import checkpointed, ranked, staged

from .corpora import short


class Corpus(NamedTuple):
    occurrences: DataFrame
    main_list: DataFrame | None
    tfidf: DataFrame
    cooccurrences: DataFrame
    scores: DataFrame
    map_list: DataFrame


def corpus_workflow(terms: DataFrame, groups: DataFrame | None, stop: DataFrame, map_limit: int = 350, threshold: int = 3) -> Corpus:
    """Stop list, groups, occurrences, ranking, main list, document tf-idf, co-occurrences, specificity and map list, in this
    order, over all corpora of ``terms`` as one (K1). Without given ``groups`` terms are grouped by their stems (G1). ``terms`` are
    written once, and every step reads them from there; what needs no documents reads their sums by corpus and term."""
    terms = staged(terms)
    sums = checkpointed(M.occurrences(terms).withColumnRenamed("occurrences", "weight"))
    stops = checkpointed(L.stop_terms(sums, stop))
    if groups is None:
        groups = L.group_by_stem(sums, stops)
    groups = short(checkpointed(groups))
    ranking = M.tfidf_ranking(terms, terms, groups).select(F.lit("all").alias("corpus_id"), "term", "score")
    main = checkpointed(L.main_list(ranking, stops))
    listed = L.union(main, groups.join(main, groups["mainform"] == main["term"], "left_semi").select(F.col("subform").alias("term")))
    return _measure(terms, sums, groups, main, listed, map_limit, threshold)


def recount(terms: DataFrame, groups: DataFrame, map_terms: DataFrame, threshold: int = 3) -> Corpus:
    """Metrics anew after lists or groups changed, the diagonal kept (K2)."""
    listed = L.union(map_terms, groups.join(map_terms, groups["mainform"] == map_terms["term"], "left_semi").select(F.col("subform").alias("term")))
    return _measure(terms, terms, groups, map_terms, listed, None, threshold)


def recount_changes(terms: DataFrame, before: Corpus, old: DataFrame, new: DataFrame, old_terms: DataFrame, new_terms: DataFrame, threshold: int = 3) -> Corpus:
    """``recount`` of the groups ``new`` and the list ``new_terms`` from what it gave for ``old`` and ``old_terms`` (K2).

    A term changes if it stands under another form than before, or is listed where it was not; the forms it stood and stands under are
    touched. Only the touched forms are counted again, and their pairs only in the documents that hold one of them; all other
    counts are taken over. ``before.cooccurrences`` must hold the pairs of the same threshold.
    """

    def forms(groups: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
        subs = groups.join(chosen, groups["mainform"] == chosen["term"], "left_semi").select(F.col("subform").alias("term"))
        return L.main_form(groups, L.union(chosen, subs)).withColumnRenamed("mainform", name)

    was, now = (short(checkpointed(x)) for x in (forms(old, old_terms, "was"), forms(new, new_terms, "now")))
    moved = was.join(now, "term", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    every = checkpointed(terms.select("term").distinct())
    led = L.main_form(old, every).withColumnRenamed("mainform", "was").join(L.main_form(new, every).withColumnRenamed("mainform", "now"), "term").where("was <> now")
    touched = short(checkpointed(moved.unionByName(led).select(F.explode(F.array_compact(F.array("was", "now"))).alias("term")).distinct()))
    # A document's forms are one row, so that those near a touched one are found in it.
    inside = terms.where("doc_id is not null").join(now, "term").groupBy("doc_id").agg(F.collect_set("now").alias("terms"))
    some_touched = inside.select("terms", "doc_id", F.explode("terms").alias("term")).join(touched, "term", "left_semi").select("doc_id", "terms").distinct()
    near = some_touched.select("doc_id", F.explode("terms").alias("term"))
    gone = lambda df, column: df.join(touched.withColumnRenamed("term", column), column, "left_anti")
    counted = G.touching(G.cooccurrences(near, threshold=threshold, by=()), touched)
    pairs = checkpointed(gone(gone(before.cooccurrences, "a"), "b").unionByName(counted))
    again = M.occurrences(M.substitute(terms, new).join(touched, "term", "left_semi"))
    # Where a corpus has more or fewer documents with listed terms than before, all its tf-idf change.
    size = lambda chosen, name: terms.join(chosen.select("term"), "term", "left_semi").groupBy("corpus_id").agg(F.countDistinct("doc_id").alias(name))
    grown = checkpointed(size(was, "n").join(size(now, "m"), "corpus_id", "full").where("NOT n <=> m").select("corpus_id"))
    listed = terms.join(now.select("term"), "term", "left_semi")
    some = M.tfidf_documents(listed, touched, new).join(grown, "corpus_id", "left_anti")
    whole = M.tfidf_documents(listed.join(grown, "corpus_id", "left_semi"), None, new)
    tfidf = gone(before.tfidf, "term").join(grown, "corpus_id", "left_anti").unionByName(some).unionByName(whole)
    scores = G.specificity(pairs)
    return Corpus(gone(before.occurrences, "term").unionByName(again), new_terms, tfidf, pairs, scores, new_terms.select("term", F.lit("given").alias("picked_by")))


def _measure(terms, sums, groups, main, listed, map_limit, threshold) -> Corpus:
    """Documents' listed terms are dealt by document once and written, one row a document, as the numbers of their forms: pairs and
    tf-idf are counted from these rows. ``sums`` has the weights of ``terms`` by corpus and term, or finer."""
    forms = checkpointed(L.main_form(groups, listed))
    ids = ranked(forms.select(F.col("mainform").alias("term")).distinct(), F.col("term"), name="id")
    numbers = short(checkpointed(forms.join(ids.withColumnRenamed("term", "mainform"), "mainform").select("term", "id")))
    found = terms.join(numbers, "term").select("corpus_id", "doc_id", "id", "weight").repartition("doc_id").groupBy("corpus_id", "doc_id", "id").agg(F.sum("weight").alias("tf"))
    apart = F.when(F.col("doc_id").isNull(), F.col("id"))  # rows of no document are not one row
    docs = staged(found.groupBy("doc_id", apart.alias("apart")).agg(F.collect_list(F.struct("corpus_id", "id", "tf")).alias("terms")))
    known = docs.where("doc_id is not null").select("doc_id", F.sort_array(F.array_distinct("terms.id")).alias("ids"))
    pairs = checkpointed(G.numbered_cooccurrences(known, ids, threshold))
    scores = G.specificity(pairs)
    picked = L.map_list(scores, main, groups, map_limit) if map_limit else main.select("term", F.lit("given").alias("picked_by"))
    return Corpus(M.occurrences(sums, groups), main, _document_tfidf(docs, ids), pairs, scores, picked)


def _document_tfidf(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """What metrics.tfidf_documents gives, from documents' rows of (corpus_id, id, tf): a corpus's documents with a term are its rows."""
    rows = docs.select("doc_id", F.explode("terms").alias("t")).select("t.corpus_id", "doc_id", "t.id", "t.tf")
    sizes = docs.select("doc_id", F.explode(F.array_distinct("terms.corpus_id")).alias("corpus_id")).groupBy("corpus_id").agg(F.count("doc_id").alias("N"))
    counts = rows.groupBy("corpus_id", "id").agg(F.count("*").alias("nd")).join(sizes, "corpus_id").join(ids, "id")
    idf = short(checkpointed(counts.select("corpus_id", "id", "term", (F.ln("N") - F.ln("nd")).alias("idf"))))
    return rows.join(idf, ["corpus_id", "id"]).select("corpus_id", "doc_id", "term", (F.col("tf") * F.col("idf")).alias("score"))


def graph_links(edges: DataFrame) -> DataFrame:
    """Links with weights to three places."""
    return edges.select("s", "t", F.round("w", 3).alias("w"))


def graph_nodes_json(nodes: DataFrame) -> DataFrame:
    """(json): compact nodes {id, lb, s, at {cl[, growth]}}."""
    at = F.struct(F.col("cluster").alias("cl"), *([F.col("growth")] if "growth" in nodes.columns else []))
    return nodes.select(F.to_json(F.struct("id", F.col("label").alias("lb"), F.col("size").alias("s"), at.alias("at"))).alias("json"))
