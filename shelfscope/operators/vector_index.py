"""Vector retrieval from a stored index: inverted lists by trained centres, product-quantised codes, exact scores for survivors.

Each vector lies in the list of its nearest centre; what is left of it is cut into parts, and each part is
named by one byte, its nearest code word. A search reads the codes of the lists nearest to a query, keeps the
best by their decoded vectors, and scores those exactly: an approximate answer (``indexed_vector_top``).
The distance from a vector to its decoded form is stored too and bounds the error of the code, so that
``exact_vector_top`` can pass over every vector that cannot be among the best; its answer is that of ``vector_top``.

Centres and code words are trained on a sample of bounded size (``SAMPLE`` rows, or 16 a centre); every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators.search import HIT_ROWS, PAIRS, POINT_BLOCK, _lists, _passed, _rows, _VectorBatch, top_per_query
from shelfscope.operators.skew import within
from shelfscope.session import stored

SAMPLE = 20_000
MOST_CENTRES = 4096
PARTS = 16
CODES = 256
BUCKETS = 64
#: Share of the lists that a query reads, and survivors for each hit that is asked for. The share suits vectors that point in
#: all directions alike, where 0.4 of the lists hold 0.82 of the ten nearest and 0.6 hold 0.94; clustered ones need far less.
PROBED = 0.65
REFINE = 10
#: Queries whose tables of products one task holds.
QUERIES = 1024


def _matrix(column, n: int) -> np.ndarray:
    return _lists(column)[0].astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, the first of equals."""
    half = (centres * centres).sum(1) / 2
    step = max(1, PAIRS // max(1, len(centres)))
    return np.concatenate([np.argmin(half - x[a:a + step] @ centres.T, axis=1) for a in range(0, len(x), step)] or [np.zeros(0, int)])


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k means from the first distinct rows on; a centre that loses its rows stays where it was."""
    centres = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _trained(k: int):
    """The k means of one part's rows, in the order of a hash of their row."""

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("row_id", "ascending")])
        made = _means(_matrix(table["vector"], table.num_rows), k)
        part = table["part"][0].as_py()
        return pa.table({"part": pa.array([part] * len(made), pa.int32()), "place": pa.array(range(len(made)), pa.int32()),
                         "vector": pa.array(list(made), pa.list_(pa.float64()))})

    return train


@dataclass(frozen=True)
class Quantiser:
    """``centres`` (lists, dimensions) and ``words`` (parts, codes, dimensions of a part); dimensions are filled up with zeros."""

    centres: np.ndarray
    words: np.ndarray

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.words.shape[0] * self.words.shape[2] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of each vector."""
        cell = _nearest(x, self.centres)
        rest = self.wide(x - self.centres[cell]).reshape(len(x), *self.words.shape[::2])
        codes = np.stack([_nearest(rest[:, p], self.words[p]) for p in range(len(self.words))], axis=1)
        near = np.stack([self.words[p][codes[:, p]] for p in range(len(self.words))], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(((rest - near) ** 2).sum((1, 2)))


@dataclass(frozen=True)
class VectorIndex:
    """``entries`` is (doc_id, row_id, vector, cell, code, err, bucket); a search by codes reads no vectors but the survivors'."""

    quantiser: Quantiser | None
    entries: DataFrame


def _fit(docs: DataFrame, parts: int, path: str) -> None:
    """Trains centres, then the code words of each part in a task of its own, and stores both."""
    n = docs.count()
    cells = min(MOST_CENTRES, max(1, math.isqrt(n)))
    drawn = docs.select("row_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"), F.xxhash64("row_id").alias("h"))
    sample = stored(drawn.orderBy("h", "row_id").limit(max(SAMPLE, 16 * cells)).withColumn("part", F.lit(-1)), "vector-sample")
    kinds = "part int, place int, vector array<double>"
    sample.groupBy("part").applyInArrow(_trained(cells), kinds).write.mode("overwrite").parquet(f"{path}/centres")
    centres = _read_centres(docs.sparkSession, path)
    if not len(centres):
        sample.select("part", F.lit(0).alias("place"), "vector").write.mode("overwrite").parquet(f"{path}/words")
        return
    held = docs.sparkSession.sparkContext.broadcast(centres)
    width = math.ceil(centres.shape[1] / parts)

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vector"], batch.num_rows)
            rest = np.pad(x - held.value[_nearest(x, held.value)], ((0, 0), (0, parts * width - x.shape[1])))
            for p in range(parts):
                yield pa.RecordBatch.from_arrays(
                    [batch["row_id"], pa.array(list(rest[:, p * width:(p + 1) * width]), pa.list_(pa.float64())), batch["h"],
                     pa.array(np.full(len(x), p, np.int32))], ["row_id", "vector", "h", "part"])

    cut = sample.select("row_id", "vector", "h").mapInArrow(rests, f"row_id {dict(sample.dtypes)['row_id']}, vector array<double>, h long, part int")
    cut.groupBy("part").applyInArrow(_trained(CODES), kinds).write.mode("overwrite").parquet(f"{path}/words")


def _read_centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("place").toArrow()  # at most MOST_CENTRES rows
    return _matrix(rows["vector"], rows.num_rows)


def _read_quantiser(spark: SparkSession, path: str) -> Quantiser | None:
    centres = _read_centres(spark, path)
    if not len(centres):
        return None
    rows = spark.read.parquet(f"{path}/words").orderBy("part", "place").toArrow()  # CODES rows a part
    part, flat = rows["part"].to_numpy(), _matrix(rows["vector"], rows.num_rows)
    found = [flat[part == p] for p in range(part.max() + 1)]
    # a part with fewer words than others repeats its first
    most = max(map(len, found))
    return Quantiser(centres, np.stack([np.concatenate([w, np.repeat(w[:1], most - len(w), axis=0)]) for w in found]))


def write_vector_index(docs: DataFrame, path: str, parts: int = PARTS) -> VectorIndex:
    """Trains, encodes and stores ``docs`` (doc_id, vector and maybe row_id), and reads the index back. Null vectors take no
    part; vectors are equally long. A list that holds most rows lies in several files, so no task meets a whole list."""
    docs = _rows(docs).select("doc_id", "row_id", "vector").where("vector is not null")
    _fit(docs, parts, path)
    spark = docs.sparkSession
    made = _read_quantiser(spark, path)
    held = spark.sparkContext.broadcast(made)
    kinds = dict(docs.dtypes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes, err = held.value.encode(_matrix(batch["vector"], batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)],
                    [*batch.schema.names, "cell", "code", "err"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in docs.columns) + ", cell int, code binary, err double"
    coded = docs.mapInArrow(encode, schema).withColumn("bucket", F.col("cell") % BUCKETS)
    coded.repartitionByRange("bucket", "cell", "row_id").sortWithinPartitions("cell", "row_id").write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/entries")
    return read_vector_index(spark, path, kinds)


def read_vector_index(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> VectorIndex:
    """A stored index; ``types`` names the types of doc_id, row_id and vector if they are not long and array<float>."""
    known = {"doc_id": "bigint", "row_id": "bigint", "vector": "array<float>"} | (types or {})
    schema = ", ".join(f"{c} {known[c]}" for c in ("doc_id", "row_id", "vector")) + ", cell int, code binary, err double, bucket int"
    return VectorIndex(_read_quantiser(spark, path), spark.read.schema(schema).parquet(f"{path}/entries"))


class _CodeBatch(_VectorBatch):
    """Queries and the codes of the lists that they read; the relevance is that of the decoded vector."""

    def parts(self, batches):
        """Codes are short: batches stay whole."""
        return (b for b in batches if b.num_rows)

    def __init__(self, queries: pa.Table, *args, held, probes: int, **kwargs):
        super().__init__(queries, *args, **kwargs)
        quantiser = held.value
        self.base = self.matrix @ quantiser.centres.T
        parts = quantiser.wide(self.matrix).reshape(self.n, *quantiser.words.shape[::2])
        self.table = np.einsum("npd,pcd->pnc", parts, quantiser.words)
        self.read = np.zeros(self.base.shape, bool)
        np.put_along_axis(self.read, np.argsort(-self.base, axis=1, kind="stable")[:, :probes], True, axis=1)

    def decoded(self, batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, queries, and the products of the rows' decoded vectors with the queries, list by list."""
        cell = batch["cell"].to_numpy()
        codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(cell), -1)
        for c in np.unique(cell):
            rows, queries = np.flatnonzero(cell == c), np.flatnonzero(self.read[:, c])
            step = max(1, PAIRS // max(1, len(queries)))
            for a in range(0, len(rows) if len(queries) else 0, step):
                some = rows[a:a + step]
                near = np.repeat(self.base[queries, c][:, None], len(some), axis=1)
                for p, table in enumerate(self.table):
                    near += table[queries][:, codes[some, p]]
                yield some, queries, near

    def pairs(self, batch):
        for rows, queries, near in self.decoded(batch):
            q, d = np.nonzero(near >= self.bar[queries][:, None])
            yield rows[d], queries[q], near[q, d]


class _BoundedBatch(_CodeBatch):
    """Exact relevance of the vectors that their code and its error do not rule out against ``_bar``, a relevance that k others reach."""

    def __init__(self, queries: pa.Table, *args, **kwargs):
        super().__init__(queries, *args, **kwargs)
        known = queries["_bar"].to_numpy(zero_copy_only=False)
        self.known = np.where(np.isnan(known), -np.inf, known)
        self.length = np.sqrt((self.matrix**2).sum(1))

    def pairs(self, batch):
        points, err = _matrix(batch["vector"], batch.num_rows), batch["err"].to_numpy()
        for rows, queries, near in self.decoded(batch):
            bar = np.maximum(self.known, self.bar)[queries]
            q, d = np.nonzero(near + self.length[queries][:, None] * err[rows] >= bar[:, None] - 1e-8)
            step = max(1, PAIRS // points.shape[1])
            for a in range(0, len(q), step):
                i, j = rows[d[a:a + step]], queries[q[a:a + step]]
                yield i, j, np.round(np.einsum("nd,nd->n", points[i], self.matrix[j]), 9)


def _asked(queries: DataFrame, *more: str) -> tuple[DataFrame, int]:
    queries = queries.select("query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"), *more).where("vector is not null")
    return queries, 1 if within(queries, QUERIES) else math.ceil(queries.count() / QUERIES)


def _none(index: VectorIndex, queries: DataFrame) -> DataFrame:
    kinds = dict(index.entries.dtypes)
    return queries.sparkSession.createDataFrame(
        [], f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kinds['doc_id']}, row_id {kinds['row_id']}, relevance double, rank int")


def _probed(index: VectorIndex, queries: DataFrame, held, probes: int) -> list[int]:
    """The buckets of the lists that the queries read, at most ``BUCKETS``."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                read = _CodeBatch(pa.Table.from_batches([batch]), 1, held=held, probes=probes).read.any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.flatnonzero(read) % BUCKETS).astype(np.int32))], ["bucket"])

    return [r[0] for r in queries.mapInArrow(lists, "bucket int").distinct().collect()]


def indexed_vector_top(index: VectorIndex, queries: DataFrame, k: int, probed: float = PROBED, refine: int = REFINE,
                       point_block: int = POINT_BLOCK) -> DataFrame:
    """(query_id, doc_id, row_id, relevance, rank): about the k nearest documents of each query (query_id, vector) by dot
    product. The share ``probed`` of the lists is read, and ``refine`` times k survivors are scored exactly; equal
    relevance goes to the smaller id."""
    if index.quantiser is None:
        return _none(index, queries)
    asked, blocks = _asked(queries)
    held = asked.sparkSession.sparkContext.broadcast(index.quantiser)
    probes = max(1, math.ceil(probed * len(index.quantiser.centres)))
    listed = index.entries.where(F.col("bucket").isin(_probed(index, asked, held, probes)))
    kind = partial(_CodeBatch, held=held, probes=probes)
    codes = listed.select("doc_id", "row_id", "cell", "code")
    near = top_per_query(_passed(codes, asked, kind, blocks, point_block, refine * k), refine * k).select("query_id", "row_id")
    near = stored(near, "survivors")
    small = F.broadcast(near) if within(near, HIT_ROWS) else near
    found = listed.select("doc_id", "row_id", F.col("vector").alias("_v")).join(small, "row_id").join(asked, "query_id")
    product = F.aggregate(F.zip_with("_v", "vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return top_per_query(found.select("query_id", "doc_id", "row_id", F.round(product, 9).alias("relevance")), k)


def exact_vector_top(index: VectorIndex, queries: DataFrame, k: int, probed: float = PROBED, refine: int = REFINE,
                     point_block: int = POINT_BLOCK) -> DataFrame:
    """The same columns with the k nearest documents themselves: the k-th relevance of the approximate answer is a bar, and
    every vector whose code and error allow it to reach the bar is scored. Reads all vectors once."""
    if index.quantiser is None:
        return _none(index, queries)
    first = indexed_vector_top(index, queries, k, probed, refine, point_block)
    bars = stored(first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("relevance")).alias("_bar")), "bars")
    asked, blocks = _asked(queries.join(bars, "query_id", "left"), "_bar")
    held = asked.sparkSession.sparkContext.broadcast(index.quantiser)
    kind = partial(_BoundedBatch, held=held, probes=len(index.quantiser.centres))
    return top_per_query(_passed(index.entries, asked, kind, blocks, point_block, k), k).drop("score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, found, wanted, recall): how many of each query's exact hits the other answer has."""
    marked = exact.select("query_id", "row_id").join(
        found.select("query_id", "row_id", F.lit(1).alias("_hit")), ["query_id", "row_id"], "left")
    return marked.groupBy("query_id").agg(F.count("_hit").alias("found"), F.count("*").alias("wanted")).withColumn(
        "recall", F.col("found") / F.col("wanted"))
