"""Exact top-k by inner product: a Voronoi k-nearest-neighbour join.

Inner products become distances by one more component: with M the largest norm, data point
x gets sqrt(M^2 - |x|^2), a query 0; then distance^2 = |q|^2 + M^2 - 2 q.x, so nearest means
largest product, and the triangle inequality holds.

1. Pivots (a sample by hash, at most `pivots`) cut the space; every vector goes to its
   nearest pivot. Per cell: rows, the k + 1 smallest distances to the pivot; per cell of
   queries: the largest distance.
2. From these summaries alone each query cell gets a bound on the k-th distance of any of
   its queries: the k-th smallest of (query radius + distance of pivots + distance in cell).
   A data point of cell j can matter to a query cell i only if its distance to its pivot
   lies within d(i, j) - radius - bound and d(i, j) + radius + bound.
3. Query cells are packed into groups of about `group_rows` queries; a larger cell is split.
   A data row is sent once to each group that may need it, in blocks of about `block_rows`,
   and each (group, block) is solved by itself; the best k per query are merged.

Distances only rule rows out, with a margin for rounding; scores are integers and exact.
Components become floor(scale * x). Vectors that are null, empty, or hold a null or
non-finite component take no part. Shorter vectors count as padded with zeros. Rows that
share a vec_id are rows of their own: a query leaves out only itself, and its ranks are
given per row. Fewer than k candidates: all. Null vec_id: no query, a candidate whose ties
come last. Products must fit 63 bits. Empty table or no query: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.common import Scratch, stored


#: Below it, every product and partial sum of two vectors fits 63 bits (Cauchy and Schwarz).
MOST_NORM = 9.2e18


@dataclass(frozen=True)
class KnnParameters:
    k: int = 20
    scale: int = 64
    pivots: int = 128
    group_rows: int = 1024
    block_rows: int = 16_384
    margin: float = 1e-6


def integer_vectors(table: DataFrame, id_column: str, vector_column: str, p: KnnParameters) -> DataFrame:
    """vec_id, v (64-bit components as bytes), norm (squared), of each usable row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, norms = [], [], []
            for vec_id, vector in zip(batch["vec_id"].to_pylist(), batch["vector"], strict=True):
                if vector is None or not vector.is_valid or not len(vector.values) or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(p.scale * x)
                if not whole @ whole < MOST_NORM:
                    raise ValueError(f"vector {vec_id} is too long: its products do not fit 63 bits")
                v = whole.astype(np.int64)
                ids.append(vec_id)
                out.append(v.tobytes())
                norms.append(int(v @ v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.int64())], ["vec_id", "v", "norm"])

    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(convert, "vec_id long, v binary, norm long")


def matrix(vectors, dims: int) -> np.ndarray:
    """Rows of 64-bit integers from an Arrow array of bytes; shorter ones are padded with zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for k, v in enumerate(vectors):
        x = np.frombuffer(v.as_buffer(), np.int64)
        out[k, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: through floating point where every partial sum is below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def _lifted(v: np.ndarray, largest: float, data: bool) -> np.ndarray:
    x = v.astype(np.float64)
    more = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
    return np.concatenate([x, more[:, None]], axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def voronoi_knn(table: DataFrame, query: Column, id_column: str = "vec_id", vector_column: str = "embedding", p: KnnParameters = KnnParameters()) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where `query` holds (on vec_id)."""
    with Scratch(table.sparkSession, "knn") as keep:
        return stored(_voronoi_knn(table, query, id_column, vector_column, p, keep), "neighbours")


def _voronoi_knn(table: DataFrame, query: Column, id_column: str, vector_column: str, p: KnnParameters, keep: Scratch) -> DataFrame:
    spark = table.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    # Rows are told apart by vec_id and a number among the rows that share it; equal rows are interchangeable.
    copies = Window.partitionBy("vec_id").orderBy("v")
    rows = keep.stored(integer_vectors(table, id_column, vector_column, p))
    shared = rows.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1 and vec_id is not null").select("vec_id")
    repeated = rows.join(shared, "vec_id", "left_semi").withColumn("copy", F.row_number().over(copies))
    rows = keep.stored(rows.join(shared, "vec_id", "left_anti").withColumn("copy", F.lit(1)).union(repeated.select(*rows.columns, "copy")))
    n, largest, width = rows.agg(F.count("*"), F.max("norm"), F.max(F.length("v"))).first()
    if not n:
        return spark.createDataFrame([], result)
    dims = width // 8
    chosen = rows.orderBy(F.xxhash64("vec_id", "copy"), "v").limit(p.pivots).select("v").toArrow()
    centres = _lifted(matrix(chosen["v"], dims), float(largest), True)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                v, asked = matrix(batch["v"], dims), batch["asked"].to_numpy(zero_copy_only=False)
                columns = []
                for data in (True, False):
                    d = _distances(_lifted(v, float(largest), data), held.value)
                    cell = d.argmin(axis=1)
                    columns += [pa.array(cell, pa.int32(), mask=None if data else ~asked), pa.array(d[np.arange(len(d)), cell], mask=None if data else ~asked)]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["copy"], batch["v"], *columns], ["vec_id", "copy", "v", "cell", "far", "qcell", "qfar"])

    asked = F.coalesce(query, F.lit(False)).alias("asked")
    placed = keep.stored(rows.select("vec_id", "copy", "v", asked).mapInArrow(
        assign, "vec_id long, copy int, v binary, cell int, far double, qcell int, qfar double"))

    # Summaries: at most pivots x (k + 1) distances, and one row per query cell.
    near = Window.partitionBy("cell").orderBy("far")
    inner = placed.select("cell", "far").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= p.k + 1).toPandas()
    cells = placed.where("qcell is not null").groupBy("qcell").agg(F.count("*").alias("n"), F.max("qfar").alias("radius")).orderBy("qcell").toPandas()
    if cells.empty:
        return spark.createDataFrame([], result)
    between = _distances(centres, centres)
    slack = p.margin * (1 + float(np.sqrt(largest)))
    lo, hi = np.zeros((len(cells), len(centres))), np.zeros((len(cells), len(centres)))
    for row, (i, radius) in enumerate(zip(cells["qcell"], cells["radius"], strict=True)):
        reach = np.sort(radius + between[i][inner["cell"]] + inner["far"].to_numpy())
        bound = reach[p.k] if len(reach) > p.k else np.inf
        lo[row], hi[row] = between[i] - radius - bound - slack, between[i] + radius + bound + slack
    # Groups of query cells; a cell with more rows than a group is split by a hash.
    group, parts, at, room = [], [], 0, 0
    for size in cells["n"]:
        split = -(-int(size) // p.group_rows)
        if split > 1 or room + size > p.group_rows:
            at, room = at + (1 if room else 0), 0
        group.append(at)
        parts.append(split)
        if split > 1:
            at += split
        else:
            room += size
    groups = max(g + s for g, s in zip(group, parts, strict=True))
    needs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row, (g, s) in enumerate(zip(group, parts, strict=True)):
        for x in range(g, g + s):
            a, b = needs.get(x, (np.full(len(centres), np.inf), np.full(len(centres), -np.inf)))
            needs[x] = np.minimum(a, lo[row]), np.maximum(b, hi[row])
    blocks = max(1, -(-n // p.block_rows))
    plan = spark.sparkContext.broadcast((np.stack([needs[g][0] for g in range(groups)]), np.stack([needs[g][1] for g in range(groups)])))
    spread = spark.sparkContext.broadcast({int(c): (g, s) for c, g, s in zip(cells["qcell"], group, parts, strict=True)})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = plan.value
        for batch in batches:
            cell, far = batch["cell"].to_numpy(), batch["far"].to_numpy()
            for g in range(groups):
                wanted = pa.array((low[g][cell] <= far) & (far <= high[g][cell]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, g, np.int32)), batch["block"], batch["vec_id"], batch["copy"], batch["v"]],
                    ["grp", "block", "vec_id", "copy", "v"]).filter(wanted)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([spread.value[c][0] for c in batch["qcell"].to_pylist()], np.int32)
            split = np.array([spread.value[c][1] for c in batch["qcell"].to_pylist()], np.int64)
            g = pa.array(first + (batch["salt"].to_numpy() % split).astype(np.int32))
            for b in range(blocks):
                yield pa.RecordBatch.from_arrays(
                    [g, pa.array(np.full(batch.num_rows, b, np.int32)), batch["vec_id"], batch["copy"], batch["v"]], ["grp", "block", "vec_id", "copy", "v"])

    kind = "grp int, block int, vec_id long, copy int, v binary"
    block = F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks)).cast("int").alias("block")
    data = placed.select("cell", "far", block, "vec_id", "copy", "v").mapInArrow(send, kind)
    salt = F.pmod(F.xxhash64("copy", "vec_id"), F.lit(1 << 30)).alias("salt")
    asking = placed.where("qcell is not null").select("qcell", salt, "vec_id", "copy", "v").mapInArrow(ask, kind)

    def solve(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_copy": [], "vec_id": [], "score": []}
        if queries.num_rows and points.num_rows:
            none = np.iinfo(np.int64).max
            ids = points["vec_id"].combine_chunks()
            ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), none, ids.fill_null(0).to_numpy())
            order = np.lexsort((points["copy"].to_numpy(), ids))
            ids, copies, x = ids[order], points["copy"].to_numpy()[order], matrix(points["v"], dims)[order]
            q_ids, q_copies = queries["vec_id"].to_numpy(), queries["copy"].to_numpy()
            for a in range(0, len(q_ids), 128):
                score = products(matrix(queries["v"].slice(a, 128), dims), x)
                for k in range(len(score)):
                    s = score[k]
                    own = (ids == q_ids[a + k]) & (copies == q_copies[a + k])
                    s = s[~own]
                    who = ids[~own]
                    if len(s) > p.k:
                        least = np.partition(s, len(s) - p.k)[len(s) - p.k]
                        sure = np.flatnonzero(s > least)
                        tie = np.flatnonzero(s == least)[: p.k - len(sure)]  # rows stand in order of vec_id
                        s, who = s[np.concatenate([sure, tie])], who[np.concatenate([sure, tie])]
                    out["query_id"] += [q_ids[a + k]] * len(s)
                    out["query_copy"] += [q_copies[a + k]] * len(s)
                    out["vec_id"] += [None if i == none else int(i) for i in who]
                    out["score"] += s.tolist()
        kinds = {"query_id": pa.int64(), "query_copy": pa.int32(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    solved = asking.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInArrow(
        solve, "query_id long, query_copy int, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_copy").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
