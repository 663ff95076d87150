"""Keyword retrieval from a stored inverted index, for batches of queries that are small beside the corpus.

Documents are cut into blocks of about ``BLOCK`` that share their heaviest term. The index has
one row per (term, block): the block's documents with their weights, and the largest of these
weights. It lies in folders by bucket of the term, so a query reads the buckets of its terms only.

A query's weights times a block's largest weights bound the relevance of every document in the
block. The blocks with the highest bounds are scored first; the k-th relevance found there is a
bar that the other blocks have to reach to be scored at all. A block left out cannot hold one of
the k best, so the answer is that of a search over all documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.text import STOP_WORDS, tokens
from shelfscope.operators.search import QUERY_TERM_ROWS, top_per_query
from shelfscope.operators.skew import within
from shelfscope.operators.tfidf import TextIndex, weigh
from shelfscope.session import stored

BUCKETS = 64
BLOCK = 128
#: Blocks of a query that are scored before its bar is known.
FIRST = 8


@dataclass(frozen=True)
class InvertedIndex:
    """``vocabulary`` as in TextIndex; ``postings`` is (at, block, top, docs, bucket), docs an array of (doc_id, row_id, weight)."""

    vocabulary: DataFrame
    postings: DataFrame
    buckets: int = BUCKETS
    ngram_max: int = 2
    stop_words: Sequence[str] = STOP_WORDS

    def terms(self, queries: DataFrame, text: str) -> DataFrame:
        """(query_id, at, share), one row per known term of each query."""
        words = queries.select("query_id", tokens(text, self.stop_words).alias("_words"))
        long = weigh(words, self.vocabulary, self.ngram_max).select("query_id", F.explode(F.arrays_zip("indices", "weights")).alias("p"))
        return long.select("query_id", F.col("p.indices").alias("at"), F.col("p.weights").alias("share"))


def write_inverted_index(index: TextIndex, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> InvertedIndex:
    """Stores the index and reads it back. Documents without a known term are in no posting."""
    spark = index.vocabulary.sparkSession
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    heaviest = F.element_at("indices", F.array_position("weights", F.array_max("weights")).cast("int"))
    docs = stored(index.documents.where(F.size("indices") > 0).withColumn("_lead", heaviest), "leads")
    sizes = docs.groupBy("_lead").agg(F.ceil(F.count("*") / block).alias("_blocks"))  # at most one row per term
    place = F.col("_lead").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("row_id"), F.col("_blocks"))
    long = docs.join(F.broadcast(sizes), "_lead").select(
        "doc_id", "row_id", place.alias("block"), F.explode(F.arrays_zip("indices", "weights")).alias("p"))
    entry = F.struct("doc_id", "row_id", F.col("p.weights").alias("weight"))
    postings = long.groupBy(F.col("p.indices").alias("at"), "block").agg(
        F.max("p.weights").alias("top"), F.collect_list(entry).alias("docs")).withColumn("bucket", F.col("at") % buckets)
    postings.repartitionByRange("bucket", "at", "block").sortWithinPartitions("at", "block").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    return read_inverted_index(spark, path, dict(index.documents.dtypes), buckets, index.ngram_max, index.stop_words)


def read_inverted_index(spark: SparkSession, path: str, types: dict[str, str] | None = None, buckets: int = BUCKETS,
                        ngram_max: int = 2, stop_words: Sequence[str] = STOP_WORDS) -> InvertedIndex:
    """A stored index; ``types`` names the types of doc_id and row_id if they are not long."""
    doc, row = ((types or {}).get(c, "bigint") for c in ("doc_id", "row_id"))
    schema = f"at int, block long, top double, docs array<struct<doc_id: {doc}, row_id: {row}, weight: double>>, bucket int"
    vocabulary = spark.read.schema("at int, term string, df long, cf long, idf double").parquet(f"{path}/vocabulary")
    return InvertedIndex(vocabulary, spark.read.schema(schema).parquet(f"{path}/postings"), buckets, ngram_max, tuple(stop_words))


class _Batch:
    """The terms of a batch of queries beside the postings of their buckets."""

    def __init__(self, index: InvertedIndex, queries: DataFrame, text: str):
        terms = stored(index.terms(queries, text), "query-terms")
        wanted = [r[0] for r in terms.select(F.col("at") % index.buckets).distinct().collect()]  # at most one value per bucket
        self.postings = index.postings.where(F.col("bucket").isin(wanted))
        self.terms = F.broadcast(terms) if within(terms, QUERY_TERM_ROWS) else terms

    def bounds(self) -> DataFrame:
        met = self.postings.select("at", "block", "top").join(self.terms, "at")
        return met.groupBy("query_id", "block").agg(F.sum(F.col("share") * F.col("top")).alias("bound"))

    def scored(self, blocks: DataFrame) -> DataFrame:
        """(query_id, doc_id, row_id, relevance) of all documents of (query_id, block) that share a term with the query."""
        met = self.postings.join(self.terms, "at").join(blocks.select("query_id", "block"), ["query_id", "block"])
        each = met.select("query_id", "share", F.explode("docs").alias("d"))
        # rounded, so that copies of a document tie whatever the order of summation
        return each.groupBy("query_id", "d.doc_id", "d.row_id").agg(F.round(F.sum(F.col("share") * F.col("d.weight")), 9).alias("relevance"))


def _searched(batch: _Batch, k: int, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best of the first blocks, all blocks with their bounds and place, and those of the rest that reach the bar."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds = stored(batch.bounds().withColumn("place", place), "bounds")
    begun = stored(top_per_query(batch.scored(bounds.where(F.col("place") <= first)), k).drop("rank"), "begun")
    bars = begun.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("relevance")).alias("bar"))
    rest = bounds.where(F.col("place") > first).join(bars, "query_id").where(
        F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - F.lit(1e-8)))
    return begun, bounds, rest


def indexed_top(index: InvertedIndex, queries: DataFrame, k: int, text: str = "query", first: int = FIRST) -> DataFrame:
    """(query_id, doc_id, row_id, relevance, rank): the k best documents of each query by TF-IDF cosine, among those that
    share a term; equal relevance goes to the smaller id. Queries without a known term have no rows."""
    batch = _Batch(index, queries, text)
    begun, _, rest = _searched(batch, k, first)
    return top_per_query(begun.unionByName(batch.scored(rest)), k)


def scored_share(index: InvertedIndex, queries: DataFrame, k: int, text: str = "query", first: int = FIRST) -> float:
    """The share of the (query, block) pairs with a common term whose documents a search scores."""
    _, bounds, rest = _searched(_Batch(index, queries, text), k, first)
    return (bounds.where(F.col("place") <= first).count() + rest.count()) / max(bounds.count(), 1)
