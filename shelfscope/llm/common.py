"""What the operators share: stored tables, ranks in a total order, words, held-out rows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.session import shared_dir

#: A word: a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared folder; no two calls get the same one."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "step") -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Cuts lineage, so that a lost executor costs its own tasks only, and keeps statistics
    and column pruning for what reads the table.
    """
    folder = fresh_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """What runs inside hands its tasks at most `rows` rows at a time, so that few whole texts are held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Stored tables of one operator call, removed together once the result is stored elsewhere."""

    def __init__(self, spark: SparkSession, kind: str):
        self.folder, self.n = fresh_folder(spark, kind), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(folder := f"{self.folder}/{self.n}")
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *raised) -> None:
        from pyarrow import fs

        if self.n:
            system, path = fs.FileSystem.from_uri(self.folder)
            system.delete_dir(path)


def slices(batch, rows: int = 256):
    """Parts of an Arrow batch, so that only some texts are Python objects at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null gives no word."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold` modulo `folds`; rows without id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds the row number (from 1) of each row within `by`, in the order of `order`, nulls last.

    The rows are dealt by range over `by` and `order`, so a group of any size spreads over
    many tasks; each task numbers its own rows, and the counts of (task, group) give the
    offsets. Rows that are equal in `by` and `order` are numbered in any order.
    """
    keys = [F.col(c).asc_nulls_last() for c in by + order]
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_task", F.shiftright("_at", 33))
    parts = placed.groupBy("_task", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    parts = parts.select(F.col("_task").alias("_t"), "_first", "_before", *[F.col(c).alias(f"_of_{c}") for c in by])
    same = F.col("_task") == F.col("_t")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return placed.join(parts, same).select(*df.columns, place.alias(rank))
