"""Targets: hits by ownership, hidden gems by a rating bound under low ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.functions import scalars as X


def gem_rule(cfg: CatalogConfig) -> Column:
    """The hidden-gem rule before suspicious rows are taken out."""
    return (
        (F.col("wilson_lb") >= cfg.gem_wilson_min)
        & (F.col("owners_lower") < cfg.gem_owners_below)
        & (F.col("total_reviews_calc") >= cfg.gem_min_reviews)
    )


def make_labels(df: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """Adds ownership, rating and both targets; rows without an owner range are dropped."""
    scored = df.withColumns({
        "owners_lower": X.owners_lower("estimated_owners"),
        "positive_ratio": X.positive_ratio("positive", "total_reviews_calc"),
        "wilson_lb": X.wilson_lower_bound("positive", "total_reviews_calc", cfg.wilson_z),
    }).where(F.col("owners_lower").isNotNull())
    gem = gem_rule(cfg)
    if cfg.exclude_from_gem and "is_suspicious" in df.columns:
        gem = gem & (F.col("is_suspicious") == 0)
    return scored.withColumns({
        "target_hit": (F.col("owners_lower") >= cfg.hit_owners_min).cast("int"),
        "target_hidden_gem": gem.cast("int"),
    })


def label_summary(labelled: DataFrame, cfg: CatalogConfig) -> DataFrame:
    """One row: label rates and the gems that the anomaly flag excluded."""
    flagged = F.col("is_suspicious") == 1 if "is_suspicious" in labelled.columns else F.lit(False)
    return labelled.agg(
        F.count("*").alias("rows"),
        F.avg("target_hit").alias("hit_rate"),
        F.avg("target_hidden_gem").alias("gem_rate"),
        F.count_if(gem_rule(cfg) & flagged).alias("gems_excluded"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: class counts, positive rate and the negatives per positive."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.avg(label).alias("positive_rate"),
        F.try_divide(negatives, positives).alias("imbalance"),
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
