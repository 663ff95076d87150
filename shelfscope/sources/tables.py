"""Parquet and JSON tables, persisted search indexes and split loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write parquet and return the written table, which also cuts the lineage."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(_stored_schema(df, partition_by)).parquet(path)


def _stored_schema(df: DataFrame, partition_by: Sequence[str]) -> T.StructType:
    keep = [f for f in df.schema.fields if f.name not in partition_by]
    return T.StructType(keep + [df.schema[c] for c in partition_by])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_text_index(index, path: str) -> None:
    """``index`` is a TextIndex; its vocabulary and one row per document."""
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")


def read_text_index(spark: SparkSession, path: str, **settings):
    from shelfscope.operators.tfidf import TextIndex

    return TextIndex(
        vocabulary=spark.read.parquet(f"{path}/vocabulary"),
        documents=spark.read.parquet(f"{path}/documents"),
        **settings,
    )


def load_split(spark: SparkSession, path: str, task: str, with_text: str | None = None) -> DataFrame:
    """Rows of one task's split table, written with its ``task`` and ``split`` columns.

    ``with_text`` names a stored text index, whose weights are joined on as a map from the
    term's place in the vocabulary.
    """
    rows = spark.read.parquet(path).where(F.col("task") == task)
    if with_text is None:
        return rows
    weights = spark.read.parquet(f"{with_text}/documents").select(
        F.col("doc_id").alias("appid"), F.map_from_arrays("indices", "weights").alias("text_weights"))
    return rows.join(weights, "appid", "left")
