"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last `window` bytes rolls over the text. A byte is a boundary of level k where
the hash ends in k one-bits, so the boundaries of a level are among those of the level below,
and a chunk at level k has 2**k bytes on average. The level of a text is the highest that
still gives `least` chunks (0 if none does). Its fingerprint is the level and the signatures
of that level and the two above: one symbol of 12 bits per chunk, from the chunk and the
window before it. A change moves only the boundaries and the symbols near it. At most `most`
symbols are written; the last one then stands for the whole rest of the text.

Two fingerprints are compared at the lowest level that both have, by the edit distance of
their signatures with insertions and deletions: 1 - distance / (length + length). Without a
common level they have a likeness of 0; equal fingerprints have 1.

`neighbour_fingerprints` compares every document with the next one, and with itself after its
end has been replaced by the beginning of the next. Documents are dealt by range over id and
a hash of the text; tasks go through theirs in order, and what the last document of a task
needs of the first of the next task is paired afterwards, two texts a task.

Null text: an empty one. Order: ascending id, null ids last, rows that share an id by a hash
of their text; equal rows in any order, since they cannot be told apart. A table of one
document follows itself; an empty table gives no rows. Texts of any length are hashed as a
whole, and a task holds two at a time beside its Arrow batch. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.common import fresh_folder, rows_per_batch

LETTERS = string.ascii_letters + string.digits + "+/"
SYMBOLS = [a + b for a in LETTERS for b in LETTERS]
#: Bytes that are hashed at once.
SEGMENT = 1 << 20
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


@dataclass(frozen=True)
class Piecewise:
    window: int = 7
    least: int = 32
    most: int = 128
    levels: int = 3


def boundary_levels(raw: bytes, window: int) -> np.ndarray:
    """The level of each byte: how many one-bits end the hash of the `window` bytes up to it."""
    data, out = np.frombuffer(raw, np.uint8), np.empty(len(raw), np.uint8)
    for at in range(0, len(raw), SEGMENT):
        from_ = max(0, at - window + 1)
        part = data[from_ : at + SEGMENT].astype(np.uint32) + np.uint32(1)
        h, power = part.copy(), 1
        for k in range(1, min(window, len(part))):
            power = power * 0x01000193 & 0xFFFFFFFF
            h[k:] += part[:-k] * np.uint32(power)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        zeros = ~h
        out[at : at + SEGMENT] = np.bitwise_count((zeros & (~zeros + np.uint32(1))) - np.uint32(1))[at - from_ :]
    return out


def _signature(raw: bytes, ends: np.ndarray, p: Piecewise) -> str:
    stops = (ends + 1).tolist()
    if len(stops) >= p.most:
        del stops[p.most - 1 :]
    if raw and (not stops or stops[-1] < len(raw)):
        stops.append(len(raw))
    view, symbols, start = memoryview(raw), [], 0
    for stop in stops:
        symbols.append(SYMBOLS[zlib.crc32(view[max(0, start - p.window + 1) : stop]) & 0xFFF])
        start = stop
    return "".join(symbols)


def fingerprint(raw: bytes, p: Piecewise = Piecewise()) -> str:
    """level:signature:signature above:..."""
    levels = boundary_levels(raw, p.window)
    at_least = np.cumsum(np.bincount(levels, minlength=33)[::-1])[::-1]
    level = max(0, int(np.searchsorted(-at_least, -p.least, side="right")) - 1)
    ends = np.flatnonzero(levels >= level)
    signatures = [_signature(raw, ends[levels[ends] >= level + k], p) for k in range(p.levels)]
    return ":".join([str(level), *signatures])


def kept_symbols(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a word of bits per symbol of b."""
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    where: dict[str, int] = {}
    for k, s in enumerate(a):
        where[s] = where.get(s, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for s in b:
        if met := rows & where.get(s, 0):
            rows = (rows + met | rows - met) & full
    return same + len(a) - rows.bit_count()


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if x == y:
        return 1.0
    (low, *a), (other, *b) = x.split(":"), y.split(":")
    level = max(int(low), int(other))
    if level - int(low) >= len(a) or level - int(other) >= len(b):
        return 0.0
    s, t = ([text[k : k + 2] for k in range(0, len(text), 2)] for text in (a[level - int(low)], b[level - int(other)]))
    return 2 * kept_symbols(s, t) / (len(s) + len(t)) if s or t else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(doc_id: int | None, text: str, mine: str, following: str, theirs: str, p: Piecewise) -> tuple:
    changed = edited(text, following).encode()
    other = fingerprint(changed, p)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mine, other, likeness(mine, other), likeness(mine, theirs)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([*_OUT, ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])


def neighbour_fingerprints(docs: DataFrame, p: Piecewise = Piecewise(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, last, rows = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for doc_id, text in zip(batch["_id"], batch["_text"], strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                mine = last[2] if last and last[1] == text else fingerprint(text.encode(), p)
                if last is None:
                    head = text
                else:
                    rows.append((*_row(*last, text, mine, p), None, None, None))
                last = doc_id, text, mine
                if len(rows) == 1000:
                    yield _batch(rows, _EDGES)
                    rows = []
        if last is not None:  # the last document of the task waits for the first of the next one
            rows.append((last[0], None, None, None, None, None, None, part, head, last[1]))
            yield _batch(rows, _EDGES)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(batch["doc_id"], batch["tail"], batch["following"], strict=True):
                text, following = text.as_py(), following.as_py()
                mine, theirs = (fingerprint(x.encode(), p) for x in (text, following))
                yield _batch([_row(doc_id.as_py(), text, mine, following, theirs, p)], _OUT)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    order = [F.col("_id").asc_nulls_last(), F.col("_hash")]
    # The salt lets equal rows go to several tasks.
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_salt": F.rand(7)})
    placed = rows.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").select("_id", "_text")
    folder = fresh_folder(spark, "fingerprints")
    edges = f"{RESULT}, part int, head string, tail string"
    with rows_per_batch(spark, 1000):
        placed.mapInArrow(run, edges).write.option("compression", "zstd").parquet(folder)
    found = spark.read.schema(edges).parquet(folder)
    # One row a task of the pass above: the number of the next task that had rows, the first one behind the last.
    parts = found.where("part is not null").select("part")
    after = F.lead("part").over(Window.orderBy("part"))
    parts = parts.select("part", F.coalesce(after, F.min("part").over(Window.partitionBy())).alias("_after"))
    heads = found.where("part is not null").select(F.col("part").alias("_after"), F.col("head").alias("following"))
    tails = found.where("part is not null").select("doc_id", "part", "tail")
    ends = tails.join(parts, "part").join(heads, "_after").select("doc_id", "tail", "following")
    return found.where("part is null").select(*_OUT.names).union(ends.mapInArrow(finish, RESULT))
