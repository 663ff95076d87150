"""The raw catalog CSV: typed by column name, heavy columns never parsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.sources.split_csv import csv_records

# Long text and URL columns that no stage uses.
HEAVY_COLUMNS = (
    "detailed_description", "about_the_game", "reviews", "header_image", "website",
    "support_url", "support_email", "metacritic_url", "screenshots", "movies", "notes",
    "packages", "full_audio_languages",
)

# The columns the search catalog needs.
SEARCH_COLUMNS = (
    "appid", "name", "short_description", "tags", "genres", "price", "positive", "negative",
    "estimated_owners", "windows", "mac", "linux", "release_date",
)

_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(
        ("appid", "positive", "negative", "recommendations", "num_reviews_total",
         "num_reviews_recent", "peak_ccu"), T.LongType()),
    **dict.fromkeys(("windows", "mac", "linux"), T.BooleanType()),
    **dict.fromkeys(
        ("pct_pos_total", "pct_pos_recent", "average_playtime_forever",
         "average_playtime_2weeks", "median_playtime_forever", "median_playtime_2weeks",
         "user_score", "metacritic_score", "discount"), T.DoubleType()),
}

_CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def csv_schema(header: Sequence[str]) -> T.StructType:
    """Types by name. Columns that may hold dirty values stay strings until cleaning."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in header])


def read_raw_csv(spark: SparkSession, path: str, drop: Sequence[str] = HEAVY_COLUMNS, multi_line: bool = True,
                 split_files: bool = False) -> DataFrame:
    """Only the header line is read for names; the wanted columns alone are parsed.

    Texts may hold line breaks, so a file is one task by default. Where they do not,
    ``multi_line=False`` lets Spark split large files. Where they do, ``split_files`` lets many
    tasks read one file for a second scan of it, with the same rows (see ``csv_records``).
    """
    header = spark.read.options(**_CSV_OPTIONS).csv(path).columns
    wanted = [c for c in header if c not in set(drop)]
    if multi_line and split_files:
        row = F.from_csv("text", csv_schema(header).toDDL(), {"quote": '"', "escape": '"', "multiLine": "true"})
        return csv_records(spark, path).select(row.alias("row")).select(*[F.col("row").getField(c).alias(c) for c in wanted])
    reader = spark.read.schema(csv_schema(header)).options(**_CSV_OPTIONS, multiLine=str(multi_line).lower())
    return reader.csv(path).select(*wanted)


def read_search_csv(spark: SparkSession, path: str, multi_line: bool = True, split_files: bool = False) -> DataFrame:
    return read_raw_csv(spark, path, multi_line=multi_line, split_files=split_files).select(*SEARCH_COLUMNS)


def write_raw_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header="true", quote='"', escape='"').csv(path)
