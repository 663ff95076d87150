"""Promotion of new runs over champions, as a join of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(runs: DataFrame, champions: DataFrame, metric: str, minimum: float | None = None) -> DataFrame:
    """One decision per candidate run of (task, run_id, <metric>), against (task, run_id, value, version).

    A value under the minimum or not above the champion's is rejected.
    """
    old = champions.select("task", F.col("value").alias("old_value"), F.col("version").alias("old_version"))
    value = F.col(metric)
    low = value < minimum if minimum is not None else F.lit(False)
    kept = F.coalesce(value <= F.col("old_value"), F.lit(False))
    reason = (
        F.when(low, "under minimum").when(kept, "not above champion")
        .when(F.col("old_value").isNull(), "first champion").otherwise("better than champion"))
    return runs.join(old, "task", "left").select(
        "task", "run_id", value.alias("value"), "old_value",
        (~low & ~kept).alias("promoted"), reason.alias("reason"),
        F.when(~low & ~kept, F.coalesce("old_version", F.lit(0)) + 1).otherwise(F.col("old_version")).alias("version"))


def new_champions(decisions: DataFrame, champions: DataFrame) -> DataFrame:
    """The champions table after the decisions."""
    promoted = decisions.where("promoted").select("task", "run_id", "value", "version")
    stay = champions.join(promoted, "task", "left_anti").select("task", "run_id", "value", "version")
    return stay.unionByName(promoted)
