"""Batch search: keyword and vector retrieval, routing, facets and popularity re-ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.functions import scalars as X
from shelfscope.functions.vectors import unit
from shelfscope.operators.clean import mature, release_date
from shelfscope.operators.skew import within
from shelfscope.operators.tfidf import TextIndex, unfolded
from shelfscope.session import stored

METHODS = ("ml", "dl")
#: Query terms, or query vectors, that one task holds; larger batches of queries are cut into blocks.
QUERY_TERM_ROWS = 200_000
QUERY_BLOCK = 4096
#: Documents that one task of a block meets.
POINT_BLOCK = 50_000
#: (query, document) pairs that a task holds at a time.
PAIRS = 1 << 21
#: Hits that are broadcast to the catalog.
HIT_ROWS = 200_000


def by_rank(best: str, *ties: str) -> list[Column]:
    return [F.desc(best), *[F.asc(t) for t in ties]]


def top_per_query(scores: DataFrame, k: int, score: str = "relevance", doc: str = "doc_id") -> DataFrame:
    """The k best documents of each query with their rank; equal scores go to the smaller id."""
    ties = [doc, *(["row_id"] if "row_id" in scores.columns else [])]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*by_rank(score, *ties)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


# --- retrieval -------------------------------------------------------------

def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All items of an Arrow list column, and the number of items of each row."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False), whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


class _Batch:
    """A batch of queries, and the k best documents of each among those that passed by.

    With a popularity ``share``, the score blends the relevance, divided by the query's best,
    with the document's popularity. The queries then bring ``_top`` and ``_most``, their best
    relevance and popularity; ``maxima`` finds those instead of the best documents.
    """

    def __init__(self, queries: pa.Table, k: int, share: float = 0.0, maxima: bool = False):
        self.ids, self.n, self.k, self.share, self.maxima = queries["query_id"].combine_chunks(), queries.num_rows, k, share, maxima
        self.bar, self.kept, self.kinds = np.full(self.n, -np.inf), None, None
        self.top, self.most = np.full(self.n, -np.inf), np.zeros(self.n)
        if share and not maxima:
            self.top, self.most = queries["_top"].to_numpy(), queries["_most"].to_numpy()

    #: The list column of the documents whose items are unfolded.
    items = "vector"

    def pairs(self, batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of document and query, and relevance, of the pairs to judge."""
        raise NotImplementedError

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in parts of bounded size."""
        return unfolded(batches, self.items)

    def add(self, batch) -> None:
        self.kinds = [batch.schema.field(c).type for c in ("doc_id", "row_id")]
        docs, rows = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row_id"))
        popularity, ratio = (batch[c].to_numpy(zero_copy_only=False) for c in ("_log", "_ratio")) if self.share else (None, None)
        for d, q, relevance in self.pairs(batch):
            if self.maxima:
                np.maximum.at(self.top, q, relevance)
                np.maximum.at(self.most, q, popularity[d])
                continue
            score = relevance
            if self.share:
                part = np.divide(popularity[d], self.most[q], out=np.zeros(len(d)), where=self.most[q] != 0) * ratio[d]
                score = np.round((1 - self.share) * (relevance / (self.top[q] + 1e-9)) + self.share * part, 9)
            near = score >= self.bar[q]
            self._keep(q[near], docs[d[near]], rows[d[near]], relevance[near], score[near])

    def _keep(self, *new: np.ndarray) -> None:
        """Merges pairs with the best so far: the higher score, then the smaller id."""
        columns = new if self.kept is None else [np.concatenate(c) for c in zip(self.kept, new)]
        q, docs, rows, _, score = columns
        order = np.lexsort((rows, docs, -score, q))
        columns = [c[order] for c in columns]
        starts = np.flatnonzero(np.diff(columns[0], prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        last = place == self.k - 1
        self.bar[columns[0][last]] = columns[4][last]
        self.kept = [c[place < self.k] for c in columns]

    def rows(self) -> pa.Table:
        if self.maxima:
            seen = np.flatnonzero(np.isfinite(self.top))
            return pa.table({"query_id": self.ids.take(pa.array(seen)), "_top": self.top[seen], "_most": self.most[seen]})
        q, docs, rows, relevance, score = self.kept
        kinds = dict(zip(("doc_id", "row_id"), self.kinds))
        return pa.table({
            "query_id": self.ids.take(pa.array(q)), "doc_id": pa.array(docs, kinds["doc_id"]),
            "row_id": pa.array(rows, kinds["row_id"]), "relevance": relevance, "score": score})

    @property
    def found(self) -> bool:
        return self.maxima or self.kept is not None


class _TermBatch(_Batch):
    """Queries and documents as sorted places in the vocabulary with weights."""

    items = "indices"

    def __init__(self, queries: pa.Table, *args, **kwargs):
        super().__init__(queries, *args, **kwargs)
        at, sizes = _lists(queries["indices"])
        order = np.argsort(at, kind="stable")
        self.at, self.weight = at[order], _lists(queries["weights"])[0][order]
        self.query = np.repeat(np.arange(self.n), sizes)[order]

    def pairs(self, batch):
        (at, sizes), (weights, _) = _lists(batch["indices"]), _lists(batch["weights"])
        low = np.searchsorted(self.at, at, "left")
        n = np.searchsorted(self.at, at, "right") - low
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # documents go together until their pairs fill a part; one document has at most as many as there are query terms
        part = np.cumsum(np.bincount(doc, n, len(sizes))) // PAIRS
        cuts = np.flatnonzero(np.diff(part[doc], prepend=-1)) if len(doc) else []
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            many, first = n[a:b], low[a:b]
            where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            pair = np.repeat(doc[a:b], many) * self.n + self.query[where]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(starts):
                # rounded, so that copies of a document tie whatever the order of summation
                total = np.round(np.add.reduceat((np.repeat(weights[a:b], many) * self.weight[where])[order], starts), 9)
                yield pair[starts] // self.n, pair[starts] % self.n, total


class _VectorBatch(_Batch):
    """Queries and documents as vectors of unit length."""

    def __init__(self, queries: pa.Table, *args, **kwargs):
        super().__init__(queries, *args, **kwargs)
        self.matrix = _lists(queries["vector"])[0].astype(float).reshape(self.n, -1)

    def pairs(self, batch):
        points = _lists(batch["vector"])[0].astype(float).reshape(batch.num_rows, -1)
        step = max(1, PAIRS // self.n)
        for start in range(0, len(points), step):
            relevance = np.round(points[start:start + step] @ self.matrix.T, 9)
            d, q = np.nonzero(relevance >= (-np.inf if self.share else self.bar[None, :]))
            yield d + start, q, relevance[d, q]


def _passed(docs: DataFrame, queries: DataFrame, kind: type[_Batch], blocks: int, point_block: int, k: int,
            share: float = 0.0, maxima: bool = False) -> DataFrame:
    """What each task leaves for each query: at most k hits, or its maxima.

    One block of queries, of checked size, is broadcast to the documents. More blocks meet
    the documents' splits, each (block, split) pair in one bounded task.
    """
    types = dict(docs.dtypes)["doc_id"], dict(docs.dtypes)["row_id"], dict(queries.dtypes)["query_id"]
    out = "_top double, _most double" if maxima else f"doc_id {types[0]}, row_id {types[1]}, relevance double, score double"
    schema = f"query_id {types[2]}, {out}"
    make = partial(kind, k=k, share=share, maxima=maxima)
    if blocks <= 1:
        shared = docs.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared.value.num_rows:
                return
            task = make(shared.value)
            for batch in task.parts(batches):
                task.add(batch)
            if task.found:
                yield from task.rows().combine_chunks().to_batches()

        return docs.mapInArrow(scan, schema)
    splits = max(1, math.ceil(docs.count() / point_block))
    # stored, since queries drawn from the documents' own table would share columns with them, which a cogroup mixes up
    left = stored(queries, "queries").withColumns({
        "_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"),
        "_split": F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))})
    right = docs.withColumns({
        "_split": F.pmod(F.xxhash64("row_id"), F.lit(splits)).cast("int"),
        "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        if q.num_rows and d.num_rows:
            task = make(q)
            for batch in task.parts(d.to_batches(max_chunksize=10_000)):
                task.add(batch)
            if task.found:
                return task.rows()
        empty = {"query_id": pa.array([], q.schema.field("query_id").type)}
        if maxima:
            return pa.table(empty | {c: pa.array([], pa.float64()) for c in ("_top", "_most")})
        empty |= {c: pa.array([], d.schema.field(c).type) for c in ("doc_id", "row_id")}
        return pa.table(empty | {c: pa.array([], pa.float64()) for c in ("relevance", "score")})

    return left.groupBy("_block", "_split").cogroup(right.groupBy("_block", "_split")).applyInArrow(meet, schema)


def _top(docs: DataFrame, queries: DataFrame, kind: type[_Batch], blocks: int, point_block: int, k: int,
         share: float = 0.0) -> DataFrame:
    """(query_id, doc_id, row_id, relevance, score, rank) of the k best; only each task's best are shuffled."""
    if share > 0:
        found = _passed(docs, queries, kind, blocks, point_block, k, share, maxima=True)
        best = found.groupBy("query_id").agg(F.max("_top").alias("_top"), F.max("_most").alias("_most"))
        queries = queries.join(best, "query_id")
    return top_per_query(_passed(docs, queries, kind, blocks, point_block, k, share), k, "score")


def _rows(docs: DataFrame) -> DataFrame:
    return docs if "row_id" in docs.columns else docs.withColumn("row_id", F.col("doc_id"))


def keyword_top(index: TextIndex, queries: DataFrame, k: int, text: str = "query", docs: DataFrame | None = None,
                share: float = 0.0, block: int | None = None, point_block: int = POINT_BLOCK) -> DataFrame:
    """The k best documents of each query by TF-IDF cosine, among those that share a term.

    Each task meets whole documents with the terms of the queries, at most ``block`` of them
    at a time, and keeps k hits per query, so no (query, document) pair is shuffled before.
    """
    block = block or QUERY_TERM_ROWS
    terms = index.vectors(queries, "query_id", text).where(F.size("indices") > 0)
    total = terms.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0)).alias("n")).first()["n"]
    return _top(index.documents if docs is None else docs, terms, _TermBatch, math.ceil(total / block), point_block, k, share)


def vector_top(docs: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK,
               point_block: int = POINT_BLOCK, share: float = 0.0) -> DataFrame:
    """Exact k nearest documents by dot product; ``docs`` is (doc_id, vector) and maybe row_id,
    ``queries`` (query_id, vector), all unit length. Null vectors take no part.

    A batch of at most ``block`` queries is broadcast; a larger one is cut into blocks.
    """
    docs = _rows(docs).where("vector is not null")
    queries = queries.select("query_id", "vector").where("vector is not null")
    blocks = 1 if within(queries, block) else math.ceil(queries.count() / block)
    return _top(docs, queries, _VectorBatch, blocks, point_block, k, share)


def encode(df: DataFrame, key: str | Sequence[str], text: str, encoder: Callable[[list[str]], np.ndarray],
           batch: int = 64) -> DataFrame:
    """(key, vector): a caller's encoder over batches of texts, scaled to unit length in SQL."""
    keys = [key] if isinstance(key, str) else list(key)
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start:start + batch]
                made = encoder(part[text].fillna("").tolist())
                yield part[keys].assign(vector=[np.asarray(v, float) for v in made])

    raw = df.select(*keys, text).mapInPandas(run, f"{kinds}, vector array<double>")
    return raw.select(*keys, unit("vector").cast("array<float>").alias("vector"))


def _of_method(queries: DataFrame, method: str, k: int, index: TextIndex | None, doc_vectors: DataFrame | None,
               query_vectors: DataFrame | None, keep: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """Hits with their score; ``keep`` (row_id, _log, _ratio) names the documents that may compete."""
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}; use one of {METHODS}")
    docs = index.documents if method == "ml" else _rows(doc_vectors)
    if keep is not None:
        docs = docs.join(keep, "row_id")
    if method == "ml":
        return keyword_top(index, queries, k, docs=docs, share=share)
    wanted = query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
    return vector_top(docs, wanted, k, share=share)


def search(queries: DataFrame, method: str, k: int = 10, index: TextIndex | None = None,
           doc_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, row_id, relevance, rank) by 'ml' (TF-IDF cosine) or 'dl' (vector cosine)."""
    return _of_method(queries, method, k, index, doc_vectors, query_vectors).drop("score")


def route(queries: DataFrame, text: str = "query", max_words: int = 3) -> DataFrame:
    """Adds ``method`` and ``reason``: Hangul or long queries go to vectors, short ones to keywords."""
    hangul, short = X.has_hangul(text), X.word_count(text) <= max_words
    return queries.withColumns({
        "method": F.when(hangul, "dl").when(short, "ml").otherwise("dl"),
        "reason": F.when(hangul, "hangul text").when(short, "short keywords").otherwise("natural language"),
    })


def _by_route(queries: DataFrame, method: str, one: Callable[[DataFrame, str], DataFrame], text: str = "query") -> DataFrame:
    """The hits of one method, or for 'auto' of each query's own."""
    if method != "auto":
        return one(queries, method)
    routed = route(queries, text)
    parts = [one(routed.where(F.col("method") == m), m).withColumn("method", F.lit(m)) for m in METHODS]
    return parts[0].unionByName(parts[1])


def search_routed(queries: DataFrame, k: int, index: TextIndex, doc_vectors: DataFrame,
                  query_vectors: DataFrame, text: str = "query") -> DataFrame:
    """Each query by the method its router picks."""
    return _by_route(queries, "auto", lambda q, m: search(q, m, k, index, doc_vectors, query_vectors), text)


# --- facets and re-ranking -------------------------------------------------

def hit_facets(min_reviews: int = 0, max_price: float | None = None, platforms: Sequence[str] = ()) -> Column:
    keep = F.col("total_reviews") >= min_reviews if min_reviews else F.lit(True)
    if max_price is not None:
        keep = keep & (F.col("price") <= max_price)
    for p in platforms:
        keep = keep & F.col(p).cast("boolean")
    return keep


def _with_catalog(hits: DataFrame, catalog: DataFrame, bounded: bool) -> DataFrame:
    """Hits with their catalog rows; hits of checked number are broadcast, so that the wide catalog stays in place."""
    return (F.broadcast(hits) if bounded else hits).join(catalog.drop("doc_id"), "row_id")


def _popularity(total: str = "total_reviews") -> Column:
    return F.log1p(F.col(total).cast("double"))


def rerank(hits: DataFrame, catalog: DataFrame, k: int, min_reviews: int = 0, max_price: float | None = None,
           platforms: Sequence[str] = (), popularity_weight: float = 0.0, bounded: bool = False) -> DataFrame:
    """Hits joined to catalog rows, filtered, blended with popularity, and cut to k per query.

    Each query has a limited pool of hits, whose maxima come from a window. ``bounded`` says
    that all hits together are few enough to broadcast.
    """
    pool = _with_catalog(hits.drop("rank"), _rows(catalog), bounded).where(hit_facets(min_reviews, max_price, platforms))
    if popularity_weight <= 0:
        return top_per_query(pool.withColumn("score", F.col("relevance")), k, "score")
    query = W.partitionBy("query_id")
    pool = pool.withColumn("_log", _popularity())
    pool = pool.withColumns({"_top": F.max("relevance").over(query), "_most": F.max("_log").over(query)})
    relevance = F.col("relevance") / (F.col("_top") + F.lit(1e-9))
    popularity = F.coalesce(F.try_divide("_log", "_most"), F.lit(0.0)) * F.col("positive_ratio")
    blended = F.lit(1 - popularity_weight) * relevance + F.lit(popularity_weight) * popularity
    scored = pool.withColumn("score", F.round(blended, 9)).drop("_log", "_top", "_most")
    return top_per_query(scored, k, "score")


def search_catalog(queries: DataFrame, catalog: DataFrame, method: str, k: int = 10, pool_factor: int | None = 15,
                   index: TextIndex | None = None, doc_vectors: DataFrame | None = None,
                   query_vectors: DataFrame | None = None, popularity_weight: float = 0.0, **facets) -> DataFrame:
    """Search, facets and re-ranking in one plan.

    The pool of k x ``pool_factor`` hits is cut before the facets, so fewer than k may be
    left. With ``pool_factor=None`` the facets come first and every match competes. Catalog
    rows with one id are told apart by ``row_id``, as in the index.
    """
    catalog = _rows(catalog)
    few = lambda hits: queries.count() * hits <= HIT_ROWS
    if pool_factor is not None:
        pool = k * pool_factor
        hits = _by_route(queries, method, lambda q, m: search(q, m, pool, index, doc_vectors, query_vectors))
        return rerank(hits, catalog, k, popularity_weight=popularity_weight, bounded=few(pool), **facets)
    zero = F.lit(0.0)
    keep = catalog.where(hit_facets(**facets)).select(
        "row_id", F.coalesce(_popularity(), zero).alias("_log"), F.coalesce("positive_ratio", zero).alias("_ratio"))
    hits = _by_route(queries, method, lambda q, m: _of_method(
        q, m, k, index, doc_vectors, query_vectors, keep, max(popularity_weight, 0.0)))
    return _with_catalog(hits, catalog, few(k))


def build_search_catalog(df: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """The searchable rows: dated, mature, reviewed and described; no dedupe, no price clip."""
    rows = df.withColumns({
        "release_date": release_date(df),
        "total_reviews": X.total_reviews("positive", "negative"),
    }).where(
        mature("release_date", cfg.as_of, cfg.min_days_since_release)
        & (F.col("total_reviews") >= cfg.min_total_reviews)
        & (F.length("short_description") >= cfg.min_description_chars)
    )
    return rows.select(
        "appid", "name", "short_description",
        X.parse_list("tags").alias("tag_list"),
        X.parse_list("genres").alias("genre_list"),
        X.to_number("price").alias("price"),
        X.positive_ratio("positive", "total_reviews").alias("positive_ratio"),
        X.owners_lower("estimated_owners").alias("owners_lower"),
        "total_reviews", "windows", "mac", "linux",
        F.year("release_date").alias("release_year"),
    )
