"""Precision and recall of ranked hits against tag groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.search import HIT_ROWS
from shelfscope.session import stored

#: Gold tags that are broadcast at a time.
GOLD_ROWS = 200_000


def relevant_counts(docs: DataFrame, queries: DataFrame, block: int | None = None) -> DataFrame:
    """(query_id, relevant): documents whose ``tag_list`` holds any tag of the query's ``gold``.

    Queries go by broadcast, about ``block`` gold tags at a time. A document meets a query
    once for each tag they share and counts at the first of them, so pairs are neither kept
    apart nor shuffled: a task hands on one count per query.
    """
    tags = docs.select("tag_list", F.explode(F.array_distinct("tag_list")).alias("tag"))
    gold = queries.select("query_id", "gold", F.explode(F.array_distinct("gold")).alias("tag"))
    blocks = max(1, math.ceil(gold.count() / (block or GOLD_ROWS)))
    first = F.get(F.array_intersect("tag_list", "gold"), F.lit(0))
    counts = None
    for i in range(blocks):
        part = gold.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else gold
        found = tags.join(F.broadcast(part), "tag").where(first == F.col("tag")).groupBy("query_id").agg(
            F.count("*").alias("relevant"))
        counts = found if counts is None else counts.unionByName(found)
    return counts


def precision_recall(hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int, relevant: DataFrame | None = None) -> DataFrame:
    """(query_id, hits, relevant, precision, recall); precision divides by k, and recall is 0
    where nothing is relevant. ``relevant`` may bring the counts, if they are known."""
    top = hits.where(F.col("rank") <= k).select("query_id", "doc_id").join(queries.select("query_id", "gold"), "query_id")
    few = queries.count() * k <= HIT_ROWS
    judged = (
        (F.broadcast(top) if few else top).join(docs.select("doc_id", "tag_list"), "doc_id")
        .groupBy("query_id").agg(F.count_if(F.arrays_overlap("tag_list", "gold")).alias("hits"))
    )
    relevant = relevant_counts(docs, queries) if relevant is None else relevant
    found, known = F.coalesce("hits", F.lit(0)), F.coalesce("relevant", F.lit(0))
    return (
        queries.select("query_id").join(judged, "query_id", "left").join(relevant, "query_id", "left")
        .select(
            "query_id", found.alias("hits"), known.alias("relevant"),
            (found / F.lit(float(k))).alias("precision"),
            F.coalesce(F.try_divide(found, known), F.lit(0.0)).alias("recall"))
    )


def evaluation_run(hits_by_method: dict[str, DataFrame], docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(method, qtype, query_id, precision, recall), rounded to 3 decimals; relevance is counted once for all methods."""
    relevant = stored(relevant_counts(docs, queries), "relevant")
    runs = None
    for method, hits in hits_by_method.items():
        scored = precision_recall(hits, docs, queries, k, relevant).join(queries.select("query_id", "qtype"), "query_id")
        rows = scored.select(
            F.lit(method).alias("method"), "qtype", "query_id",
            F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"))
        runs = rows if runs is None else runs.unionByName(rows)
    return runs


def mean_precision(evaluation: DataFrame, *by: str) -> DataFrame:
    return evaluation.groupBy(*by).agg(F.avg("precision").alias("mean_precision"))


def precision_table(evaluation: DataFrame, methods: Sequence[str], qtypes: Sequence[str]) -> DataFrame:
    """Mean precision as query type x method, 3 decimals, in the stated row order; a type
    without queries keeps an empty row."""
    spark = evaluation.sparkSession
    order = spark.createDataFrame(list(enumerate(qtypes)), "row_order int, qtype string")
    table = evaluation.groupBy("qtype").pivot("method", list(methods)).agg(F.round(F.avg("precision"), 3))
    return F.broadcast(order).join(table, "qtype", "left").orderBy("row_order").select("qtype", "row_order", *methods)
