"""TF-IDF: a bounded vocabulary, and one row of unit length per document."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.text import STOP_WORDS, tokens
from shelfscope.session import spread, stored

#: Words, or terms, that a task unfolds at a time.
ITEMS = 1 << 18
#: Counters of the sketch that finds the most used n-grams.
BUCKETS = 1 << 20


@dataclass(frozen=True)
class TextIndex:
    """``vocabulary`` is (at, term, df, cf, idf), at most ``max_terms`` rows; ``documents`` is
    (doc_id, row_id, indices, weights), one row per indexed row: the places of its terms in
    the vocabulary, and weights of unit length. Rows that share a doc_id differ by row_id."""

    vocabulary: DataFrame
    documents: DataFrame
    ngram_max: int = 2
    stop_words: Sequence[str] = STOP_WORDS

    @property
    def postings(self) -> DataFrame:
        """(doc_id, term, weight), one row per term of each document."""
        long = self.documents.select("doc_id", F.explode(F.arrays_zip("indices", "weights")).alias("p"))
        named = F.broadcast(self.vocabulary.select("at", "term"))
        return long.select("doc_id", F.col("p.indices").alias("at"), F.col("p.weights").alias("weight")).join(
            named, "at").select("doc_id", "term", "weight")

    def vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, indices, weights) of other texts in this vocabulary, for example of queries."""
        words = tokens(text, self.stop_words)
        return weigh(df.select(key, words.alias("_words")), self.vocabulary, self.ngram_max)


def unfolded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose lists hold about ``ITEMS`` items together, and one row at least."""
    for batch in batches:
        upto = np.cumsum(batch[column].value_lengths().fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + ITEMS, "right")))
            yield batch.slice(at, end - at)
            at = end


class Terms:
    """Terms as arrays: finds the places of a text's n-grams among them, word by word along their prefixes."""

    def __init__(self, terms: Sequence[str], ngram_max: int):
        split = [t.split(" ") for t in terms]
        self.words = pa.array(sorted({w for t in split for w in t}), pa.string())
        self.n, self.size = len(split), max(1, len(self.words))
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        # of each length: the prefixes as (prefix before, word) keys in order, and the term that a prefix is, or -1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = {(): 0}
        for n in range(1, ngram_max + 1):
            prefixes = {tuple(t[:n]) for t in split if len(t) >= n}
            keys = sorted((before[p[:-1]] * self.size + number[p[-1]], p) for p in prefixes)
            before = {p: k for k, (_, p) in enumerate(keys)}
            at = np.full(len(keys), -1, np.int64)
            for k, t in enumerate(split):
                if len(t) == n:
                    at[before[tuple(t)]] = k
            self.levels.append((np.array([key for key, _ in keys], np.int64), at))

    def counts(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and number of each term in each row of words, rows and places ascending."""
        sizes = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        word = pc.index_in(words.flatten(), value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        row, found = np.repeat(np.arange(len(sizes)), sizes), []
        start, prefix = np.flatnonzero(word >= 0), None
        for n, (keys, at) in enumerate(self.levels, 1):
            if prefix is not None:  # those that go on with a known word of the same row
                ends = start + n - 1
                on = ends < len(word)
                on[on] = (row[start[on]] == row[ends[on]]) & (word[ends[on]] >= 0)
                start, prefix = start[on], prefix[on]
            key = (0 if prefix is None else prefix) * self.size + word[start + n - 1]
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            start, prefix = start[known], place[known]
            term = at[prefix]
            found.append(row[start[term >= 0]] * self.n + term[term >= 0])
        code, tf = np.unique(np.concatenate(found), return_counts=True)
        return code // max(self.n, 1), code % max(self.n, 1), tf


def grams(words: pa.ListArray, ngram_max: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: where the n-grams of the rows start among all words, their 64-bit hashes, and numbers of them.

    Equal n-grams have equal hashes in every batch; within one, different n-grams have different numbers."""
    sizes = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    word = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(word >= 0)
    hashes, code = known[word[start]], word[start]
    yield start, hashes, code
    for n in range(2, ngram_max + 1):
        ends = start + n - 1
        on = ends < len(word)
        on[on] = (row[start[on]] == row[ends[on]]) & (word[ends[on]] >= 0)
        start, ends = start[on], ends[on]
        hashes = (hashes[on] ^ (hashes[on] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + known[word[ends]]
        if n > 2:  # numbers of the part before, so that the product stays small
            code = np.unique(code, return_inverse=True)[1]
        code = code[on] * np.int64(len(known)) + word[ends]
        yield start, hashes, code


def _kth(counts: DataFrame, k: int) -> int:
    """The k-th highest count, or 0 if there are fewer."""
    return counts.orderBy(F.desc("n")).limit(k).agg(F.when(F.count("*") == k, F.min("n")).otherwise(0)).first()[0]


def most_used(words: DataFrame, ngram_max: int, max_terms: int, buckets: int = BUCKETS) -> DataFrame:
    """(term, n): the most used n-grams with their exact number of uses, the smaller term first on ties.

    A sketch counts n-grams by hash into ``buckets`` counters, which add up across tasks; a
    bucket's count bounds the count of each n-gram in it from above. Only n-grams of buckets
    with at least ``bar`` uses are then counted exactly. All others have fewer uses than that,
    so the result is exact once the last one in it has at least ``bar``; if not, its count is
    the next bar, and that one is low enough. So no shuffle holds the rare n-grams: the first
    has at most ``buckets`` rows a task, the second the n-grams of heavy buckets. Tasks count
    n-grams as numbers of their words; only those of heavy buckets become text, once a part.
    """
    def bucket(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in unfolded(batches, "_words"):
            for _, hashes, _ in grams(batch["_words"], ngram_max):
                n += np.bincount(bucket(hashes), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["_bucket", "n"])

    words = words.select("_words")
    sketch = stored(words.mapInArrow(add, "_bucket int, n long").groupBy("_bucket").agg(F.sum("n").alias("n")), "sketch")
    bar = _kth(sketch, 2 * max_terms)
    while True:
        heavy = np.zeros(buckets, bool)
        heavy[sketch.where(F.col("n") >= bar).select("_bucket").toArrow()["_bucket"].to_numpy()] = True  # at most `buckets` numbers
        shared = words.sparkSession.sparkContext.broadcast(heavy)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in unfolded(batches, "_words"):
                flat = batch["_words"].flatten()
                for n, (start, hashes, code) in enumerate(grams(batch["_words"], ngram_max), 1):
                    kept = shared.value[bucket(hashes)]
                    _, first, uses = np.unique(code[kept], return_index=True, return_counts=True)
                    at = start[kept][first]
                    term = pc.binary_join_element_wise(*[flat.take(pa.array(at + k)) for k in range(n)], " ")
                    yield pa.RecordBatch.from_arrays([term, pa.array(uses.astype(np.int64))], ["term", "n"])

        counts = stored(words.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "counts")
        last = _kth(counts, max_terms)
        if last >= bar or bar == 0:
            return counts.orderBy(F.desc("n"), F.asc("term")).limit(max_terms)
        bar = last


def fit_vocabulary(words: DataFrame, ngram_max: int, max_terms: int, buckets: int = BUCKETS) -> DataFrame:
    """The most used terms over the corpus, smaller term first on ties, with smoothed idf.

    ``words`` holds each text's ``_words``; stored, since it is read several times. The
    documents of a term are counted for the chosen terms only, in place.
    """
    spark = words.sparkSession
    documents = words.count()
    top = [(r["term"], r["n"]) for r in most_used(words, ngram_max, max_terms, buckets).collect()]  # at most max_terms rows
    shared = spark.sparkContext.broadcast(Terms([t for t, _ in top], ngram_max))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df = np.zeros(terms.n, np.int64)
        for batch in unfolded(batches, "_words"):
            df += np.bincount(terms.counts(batch["_words"])[1], minlength=terms.n)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], ["at", "df"])

    df = dict(words.select("_words").mapInArrow(count, "at int, df long").groupBy("at").agg(F.sum("df")).collect())
    rows = [(at, t, df[at], cf, math.log((1.0 + documents) / (1.0 + df[at])) + 1.0) for at, (t, cf) in enumerate(top)]
    return spark.createDataFrame(rows, "at int, term string, df long, cf long, idf double")


def weigh(words: DataFrame, vocabulary: DataFrame, ngram_max: int) -> DataFrame:
    """``_words`` replaced by ``indices`` and ``weights``: tf x idf scaled to unit length, terms
    outside the vocabulary left out.

    Rows stay where they are: the vocabulary, which its parameter bounds, is broadcast, n-grams
    are looked up first, and only those found are counted.
    """
    known = vocabulary.select("at", "term", "idf").orderBy("at").collect()  # at most max_terms rows
    shared = words.sparkSession.sparkContext.broadcast(
        (Terms([r["term"] for r in known], ngram_max), np.array([r["idf"] for r in known], float)))
    others = [f for f in words.schema if f.name != "_words"]
    names = [f.name for f in others]

    def weigh_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in unfolded(batches, "_words"):
            row, at, tf = terms.counts(batch["_words"])
            weight = tf * idf[at]
            length = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            stops = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(x)) for x in (at.astype(np.int32), weight / length[row])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *lists], [*names, "indices", "weights"])

    schema = T.StructType([*others, T.StructField("indices", T.ArrayType(T.IntegerType())),
                           T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return words.select(*names, "_words").mapInArrow(weigh_batch, schema)


def fit_text_index(docs: DataFrame, key: str, text: str, max_terms: int, ngram_max: int = 2,
                   stop_words: Sequence[str] = STOP_WORDS, fit_on: DataFrame | None = None) -> TextIndex:
    """Index ``docs``; the vocabulary comes from ``fit_on`` (for example train rows) if given.

    A table whose keys repeat should have a unique ``row_id`` column (see ``with_row_id``);
    without one, ``key`` names the row. The words of the texts are stored once, for the count
    and for the weights; postings and queries only read the fitted vocabulary.
    """
    row = F.col("row_id") if "row_id" in docs.columns else F.col(key)
    texts = spread(docs.select(F.col(key).alias("doc_id"), row.alias("row_id"), F.col(text).alias("_text")))
    words = texts.select("doc_id", "row_id", tokens("_text", stop_words).alias("_words"))
    if fit_on is None:
        source = words = stored(words, "words")
    else:
        source = stored(spread(fit_on.select(F.col(text).alias("_text"))).select(tokens("_text", stop_words).alias("_words")), "words")
    vocabulary = fit_vocabulary(source.select("_words"), ngram_max, max_terms)
    return TextIndex(vocabulary, weigh(words, vocabulary, ngram_max), ngram_max, tuple(stop_words))


def with_row_id(df: DataFrame, kind: str = "rows") -> DataFrame:
    """The table stored with a ``row_id`` that tells copies of a key apart; numbered in place, without a shuffle."""
    return stored(df.withColumn("row_id", F.monotonically_increasing_id()), kind)
