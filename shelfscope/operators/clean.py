"""Cleaning: first row per key, dated, mature, reviewed, with numbers coerced and clipped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.functions import scalars as X


def first_per_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in a stated order.

    Spark limits each key to one row before the shuffle, so a key with many copies
    costs no more than any other.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_first", rank).where(F.col("_first") == 1).drop("_first")


#: What cleaning decides on. Copies that tie in the stated order go by these, smallest first and missing ones before all.
FACTS = ("release_date", "positive", "negative", "price")


def total_order(df: DataFrame, order: Sequence[str | Column]) -> list[str | Column]:
    """The stated order, then what cleaning decides on, then a hash of all other columns: it tells all but equal rows
    apart, so the row that stays does not depend on partitioning. The funnel needs the first two parts only."""
    rest = [x for c in sorted(df.columns) if c not in FACTS for x in (F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").isNull())]
    return [*order, *FACTS, F.xxhash64(*rest)]


def release_date(df: DataFrame) -> Column:
    """The release date as a timestamp, parsed if the table still holds text."""
    if dict(df.dtypes)["release_date"] == "string":
        return X.parse_release_date("release_date")
    return F.col("release_date").cast("timestamp")


def mature(date: Column | str, as_of: dt.date, min_days: int) -> Column:
    """Released at least ``min_days`` before ``as_of``; the first moment of that day counts."""
    return X.col(date) <= F.date_sub(F.lit(as_of), min_days).cast("timestamp")


def clean(df: DataFrame, cfg: CatalogConfig, order: Sequence[str], unique: bool = False) -> DataFrame:
    """The first copy of each product by ``total_order``, if it is dated, mature and reviewed, with numbers coerced.

    ``unique`` says that no product has two rows, as the caller has checked: nothing can tie then, so the stated order
    is enough, and columns that nobody asks for are not read."""
    rows = first_per_key(df, "appid", list(order) if unique else total_order(df, order))
    rows = rows.withColumns({
        "release_date": release_date(df),
        "total_reviews_calc": X.total_reviews("positive", "negative"),
    }).where(
        F.col("release_date").isNotNull()
        & mature("release_date", cfg.as_of, cfg.min_days_since_release)
        & (F.col("total_reviews_calc") >= cfg.min_total_reviews)
    )
    tidy = {"price": X.clip(X.to_number("price"), upper=cfg.price_clip_max)}
    if "required_age" in df.columns:
        tidy["required_age"] = X.clip(X.to_number("required_age"), 0.0, float(cfg.max_age_rating))
    for c in ("dlc_count", "achievements"):
        if c in df.columns:
            tidy[c] = X.to_number(c)
    return rows.withColumns(tidy)


def cleaning_funnel(df: DataFrame, cfg: CatalogConfig, order: Sequence[str]) -> DataFrame:
    """One row: what each cleaning step removes, with the same first copies as ``clean``. One aggregate over narrow columns."""
    facts = F.struct(
        release_date(df).alias("date"),
        X.total_reviews("positive", "negative").alias("reviews"),
        X.to_number("price").alias("price"),
    )
    firsts = df.groupBy("appid").agg(
        F.count("*").alias("copies"), F.min_by(facts, F.struct(*order, *[F.col(c).alias(f"_{c}") for c in FACTS])).alias("f"))
    dated = F.col("f.date").isNotNull()
    old = dated & mature("f.date", cfg.as_of, cfg.min_days_since_release)
    kept = old & (F.col("f.reviews") >= cfg.min_total_reviews)
    counts = firsts.agg(
        F.sum("copies").alias("rows_in"),
        F.count("*").alias("_unique"),
        F.count_if(dated).alias("_dated"),
        F.count_if(old).alias("_old"),
        F.count_if(kept).alias("rows_out"),
        F.count_if(kept & (F.col("f.price") > cfg.price_clip_max)).alias("prices_clipped"),
    )
    return counts.select(
        "rows_in",
        (F.col("rows_in") - F.col("_unique")).alias("duplicates_removed"),
        (F.col("_unique") - F.col("_dated")).alias("bad_dates_removed"),
        (F.col("_dated") - F.col("_old")).alias("too_recent_removed"),
        (F.col("_old") - F.col("rows_out")).alias("too_few_reviews_removed"),
        "prices_clipped",
        "rows_out",
        F.try_divide("rows_out", "rows_in").alias("kept_share"),
    )
