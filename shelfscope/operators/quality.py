"""Run metadata, range checks and a content fingerprint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted ranges of a finished run; None leaves an end open.
RULES = (
    ("rows", 35_000.0, 55_000.0),
    ("hit_rate", 0.05, 0.40),
    ("gem_rate", 0.05, 0.40),
    ("features", 50.0, 120.0),
    ("leakage_columns", 15.0, None),
)


class QualityError(RuntimeError):
    """A finished run is outside its accepted ranges."""


def quality_checks(meta: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """(check, value, low, high, passed) of a one-row metadata table."""
    def check(name: str, low, high):
        value = F.col(name).cast("double")
        ok = F.lit(True)
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
        bound = lambda b: F.lit(None if b is None else float(b)).cast("double")
        return F.struct(F.lit(name).alias("check"), value.alias("value"), bound(low).alias("low"),
                        bound(high).alias("high"), F.coalesce(ok, F.lit(False)).alias("passed"))
    return meta.select(F.inline(F.array(*[check(*r) for r in rules])))


def require_quality(checks: DataFrame) -> DataFrame:
    """Raises if a check fails; there is one row per rule."""
    failed = [f"{r['check']}={r['value']}" for r in checks.where(~F.col("passed")).collect()]
    if failed:
        raise QualityError("outside the accepted range: " + ", ".join(failed))
    return checks


def run_metadata(labels: DataFrame, funnel: DataFrame, features: int, leaked: Sequence[str],
                 config: Mapping[str, str], data_hash: str | None = None) -> DataFrame:
    """One row: label rates, the cleaning funnel, feature and leakage counts, and the settings."""
    stats, steps = labels.first(), funnel.first()
    spark = labels.sparkSession
    row = (stats["rows"], stats["hit_rate"], stats["gem_rate"], stats["gems_excluded"], features,
           len(leaked), list(leaked), {k: float(v) for k, v in steps.asDict().items() if v is not None},
           dict(config), data_hash)
    return spark.createDataFrame([row], (
        "rows long, hit_rate double, gem_rate double, gems_excluded long, features int, leakage_columns int, "
        "leaked array<string>, cleaning map<string,double>, config map<string,string>, data_hash string"))


def _row_bits(columns: Mapping[str, Column] | Sequence[str]) -> Column:
    """The leading 60 bits of a row's md5."""
    parts = columns.values() if isinstance(columns, Mapping) else [F.col(c) for c in columns]
    # each value with its length, so that no two rows give one text
    values = [c.cast("string") for c in parts]
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def _digest(rows: Column, total: Column) -> Column:
    text = F.concat_ws(":", F.coalesce(rows, F.lit(0)).cast("string"), F.coalesce(total, F.lit(0)).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 12).alias("data_hash")


def fingerprint(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """12 hex digits that depend on the rows but not on their order.

    Each row gives an md5; its leading 60 bits are summed with the row count and hashed.
    """
    return df.agg(_digest(F.count("*"), F.sum(_row_bits(columns))))


def fingerprint_parts(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], *by: str) -> DataFrame:
    """(by, rows, total): what each part of the table adds to its fingerprint. Stored, it spares reading old data again:
    rows that are appended later bring rows of their own, even for a part that is there already."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(_row_bits(columns)).cast("decimal(38,0)").alias("total"))


def merged_fingerprint(parts: DataFrame) -> DataFrame:
    """The fingerprint of all rows, from stored parts."""
    return parts.agg(_digest(F.sum("rows"), F.sum("total")))
