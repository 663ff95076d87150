"""Records of multi-line CSV files read by many tasks: a file's byte ranges are cut at record ends found by quote parity.

A line starts a record if the quotes before it in its file are even in number; doubled quotes
do not change that. One scan counts the odd lines of each range, a running sum over the ranges
(one small row each) tells which of them start inside quotes, and a second scan joins each
range's lines to records where they are. Only records that cross a range's end are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PARTS = "text string, owner long, place long, open boolean, head boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with their byte range and whether their quotes are odd in number."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"),
        F.col("_metadata.file_block_length").alias("size"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.withColumns({"odd": quotes % 2 == 1, "block": F.xxhash64("file", "place", "size")})


def _ranges(lines: DataFrame) -> DataFrame:
    """block, inside (it starts inside quotes), owner (the range where the record it starts in begins), unpaired quotes."""
    numbered = lines.withColumn("n", F.monotonically_increasing_id())
    ranges = numbered.groupBy("file", "place", "block").agg(
        F.sum(F.col("odd").cast("long")).alias("odds"), F.min(F.when(F.col("odd"), F.col("n"))).alias("first_odd"), F.max("n").alias("last"))
    before = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2 == 1)
    starts = ~F.col("inside") | F.coalesce(F.col("first_odd") < F.col("last"), F.lit(False))
    return ranges.select(
        "block", "inside", F.last(F.when(starts, F.col("block")), ignorenulls=True).over(before).alias("owner"),
        (F.sum("odds").over(W.partitionBy("file")) % 2 == 1).alias("unpaired"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the open parts of those that cross the range's end (owner, place); memory is one batch and one record."""
    block = inside = state = None
    held: list[str] = []

    def part(text: str, still_open: bool):
        """The lines held so far end here: at a record's end, or with the range."""
        whole = state["begun"] and not still_open
        head = state["head"] and state["begun"] and bool(text)
        if head:
            state["head"] = False
        return text, None if whole else (block if state["begun"] else state["owner"]), state["place"], not whole, head

    for batch in batches:
        out = []
        values, blocks = batch["value"].to_pylist(), batch["block"].to_numpy()
        odd = batch["odd"].to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)) if len(blocks) else []
        for start, stop in zip(runs, [*runs[1:], len(blocks)], strict=True):
            if blocks[start] != block:
                if held:
                    out.append(part("\n".join(held), True))
                held, block = [], int(blocks[start])
                row = {c: batch[c][int(start)].as_py() for c in ("inside", "owner", "place", "unpaired")}
                if row["inside"] is None:
                    raise RuntimeError("the files were split in another way than in the first scan; set spark.sql.files.minPartitionNum")
                if row["unpaired"]:
                    raise ValueError("a file has a quote without its partner")
                inside = row["inside"]
                state = {"begun": not inside, "owner": row["owner"], "place": row["place"], "head": row["place"] == 0}
            for value, flips in zip(values[start:stop], odd[start:stop], strict=True):
                held.append(value)
                inside ^= bool(flips)
                if not inside:
                    out.append(part("\n".join(held), False))
                    held, state["begun"] = [], True
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5,
                                            (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)],
            ["text", "owner", "place", "open", "head"])
    if held:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("text", "owner", "place", "open", "head"), part("\n".join(held), True), strict=True))],
            pa.schema([("text", pa.string()), ("owner", pa.int64()), ("place", pa.int64()), ("open", pa.bool_()), ("head", pa.bool_())]))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text): each record of the CSV files under ``path`` but the header, with its quotes and line breaks.

    For files in UTF-8 whose quotes occur in pairs, as writers of quoted fields give them; a file that ends
    inside quotes is an error. Line breaks are ``\\n`` or ``\\r\\n``. Empty lines between records are skipped.
    Both scans must split the files alike: where the number of cores may change between them, set
    ``spark.sql.files.minPartitionNum``; a difference is an error, not a wrong result.
    """
    lines = _lines(spark, path)
    told = lines.join(F.broadcast(_ranges(lines)), "block", "left").select("value", "odd", "block", "place", "inside", "owner", "unpaired")
    parts = told.mapInArrow(_records, _PARTS)
    whole = parts.where(~F.col("open")).select("text", "head")
    crossing = parts.where("open").groupBy("owner").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("pieces"), F.max("head").alias("head"))
    joined = crossing.select(F.array_join(F.col("pieces.text"), "\n").alias("text"), "head")
    records = whole.unionByName(joined).where(~F.col("head")).select(F.rtrim("text", F.lit("\r")).alias("text"))
    return records.where(F.length("text") > 0)
