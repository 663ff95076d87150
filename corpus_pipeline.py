"""A corpus run: language, near duplicates, benchmark items, mixture, token files.

Each stage takes the documents its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import queries
from shelfscope.llm.common import held_out, ranked, rows_per_batch, stored
from shelfscope.llm.decontaminate import decontaminated
from shelfscope.llm.language import fit_and_identify
from shelfscope.llm.mixing import mixed
from shelfscope.llm.near_dedup import near_duplicates, without
from shelfscope.llm.token_planes import token_table

#: A text whose main language has a smaller share of its letters is rejected.
LEAST_SHARE = 0.3
#: Texts in an Arrow batch of the language stage, and pieces that a worker of the token files remembers: the JVM of an executor is
#: full by the earlier stages, so its Python workers have little left. The rows do not depend on either.
BATCH, REMEMBERED = 1000, 30_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts without a main language, go. Stored here, since batches are bounded while the stage runs."""
    kept = (F.col("_language_found.lang_pred") != "und") & (F.col("_language_found.score") >= LEAST_SHARE)
    with rows_per_batch(spark, BATCH):
        found = fit_and_identify(docs, ~held_out(F.col("doc_id"), 4, 2), into="_language_found")
        return stored(found.where(kept).select(*docs.columns), "stage-language")


def _own_ids(docs: DataFrame) -> DataFrame:
    """The documents with an id of their own, `_row`: the doc_id where one row has it. Rows that share a doc_id, or have none,
    are numbered above all ids if their texts differ; of those that share the text too, the one with the least hash stays."""
    docs = docs.withColumns({"_text": F.xxhash64("text"), "_all": F.xxhash64(*docs.columns)})
    shared = stored(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "shared-ids")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = docs.select("doc_id", "_text", "_all").join(shared, same, "left_semi").groupBy("doc_id", "_text").agg(F.min("_all").alias("_all"))
    most, least = docs.agg(F.max("doc_id"), F.min("doc_id")).first()
    above = most is None or most < 1 << 62
    number = F.lit(most or 0) + F.col("_n") if above else F.lit(least) - F.col("_n")
    numbered = stored(ranked(texts, [], ["doc_id", "_text"], "_n").select(
        F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), F.col("_all").alias("_least"), number.alias("_row")), "own-ids")
    chosen = docs.join(numbered, same & (F.col("_text") == F.col("_of")) & (F.col("_all") == F.col("_least"))).dropDuplicates(["_row"])
    alone = docs.join(shared, same, "left_anti").withColumn("_row", F.col("doc_id").cast("long"))
    return alone.drop("_text", "_all").unionByName(chosen.drop("_text", "_all", "_id", "_of", "_least"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows that share an id are documents of their own."""
    own = _own_ids(docs).withColumnsRenamed({"doc_id": "_doc_id", "_row": "doc_id"})
    copies = near_duplicates(own).where("not kept").select("doc_id")
    return without(own, copies).drop("doc_id").withColumnRenamed("_doc_id", "doc_id").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; the index read back from them."""
    return token_table(spark, docs, queries.vocabulary(), queries.END_ID, remembered=REMEMBERED)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: Language identification has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    for name, stage in STAGES[1:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
