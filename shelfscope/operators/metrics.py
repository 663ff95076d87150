"""Classifier metrics over scored tables, per run if asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.skew import running_totals


def score_curve(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: ``pos`` and ``n`` at it, ``cum_*`` at or above it, ``all_*``."""
    groups = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    return running_totals(groups, "score", ("pos", "n"), by)


def binary_metrics(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """Average precision, ROC area, precision, recall and F1 at ``cut``, and the best-F1 threshold.

    Average precision is the step sum; equal scores count as one threshold; the lowest of
    equally good thresholds wins. The ROC area of a group with one class is null.
    """
    tp, upto, pos, n = F.col("cum_pos"), F.col("cum_n"), F.col("pos"), F.col("n")
    all_pos, all_n = F.col("all_pos"), F.col("all_n")
    precision = tp / upto
    recall = F.coalesce(F.try_divide(tp, all_pos), F.lit(0.0))
    f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    above = F.col("score") >= cut
    curve = score_curve(scored, label, score, by).withColumns({
        "_ap": F.coalesce(F.try_divide(pos, all_pos), F.lit(0.0)) * precision,
        "_auc": (n - pos) * (tp - pos / F.lit(2.0)),
        "_f1": f1,
    })
    zero = F.lit(0.0)
    best = F.max_by(F.struct("score", "_f1"), F.struct(F.col("_f1"), -F.col("score")))
    totals = curve.groupBy(*by).agg(
        F.sum("_ap").alias("pr_auc"), F.sum("_auc").alias("_pairs"),
        F.max(all_pos).alias("positives"), F.max(all_n).alias("_all"),
        F.sum(F.when(above, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(above, n).otherwise(0)).alias("_pp"),
        best.alias("_best"))
    p, r = F.coalesce(F.try_divide("_tp", "_pp"), zero), F.coalesce(F.try_divide("_tp", "positives"), zero)
    return totals.select(
        *by, F.col("_all").alias("rows"), "positives", "pr_auc",
        F.try_divide(F.col("_pairs"), F.col("positives") * (F.col("_all") - F.col("positives"))).alias("roc_auc"),
        p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), zero).alias("f1"),
        F.col("_best.score").alias("best_threshold"), F.col("_best._f1").alias("f1_at_best"),
    )


def confusion(predicted: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return predicted.groupBy(*by, F.col(label).cast("string").alias("actual"),
                             F.col(prediction).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(row, precision, recall, f1, support) per class, and rows 'accuracy', 'macro avg', 'weighted avg'.

    Works on the confusion counts, which have one row per pair of classes.
    """
    cells = confusion(predicted, label, prediction)
    same = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("row"), same.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("predicted").alias("row"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))
    per_class = cells.select(F.inline(sides)).groupBy("row").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("tp", "called"), zero), F.coalesce(F.try_divide("tp", "support"), zero)
    scored = per_class.select("row", "tp", p.alias("precision"), r.alias("recall"),
                              F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), zero).alias("f1"), "support")
    total = F.sum("support")
    accuracy = F.sum("tp") / total

    def weighted(c: str):
        return (F.sum(F.col(c) * F.col("support")) / total).alias(c)

    summary = scored.agg(F.array(
        F.struct(F.lit("accuracy").alias("row"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), total.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), weighted("precision"), weighted("recall"),
                 weighted("f1"), total.alias("support")),
    ).alias("s")).select(F.inline("s"))
    return scored.drop("tp").unionByName(summary)


def best_run(runs: DataFrame, metric: str, by: str = "task", key: str = "run_id") -> DataFrame:
    """The best run per task; the smaller run id wins a tie."""
    from shelfscope.operators.clean import first_per_key

    return first_per_key(runs, by, [F.desc(metric), F.asc(key)])


def with_efficiency(results: DataFrame, score: str = "mean_test_score", seconds: str = "mean_fit_time") -> DataFrame:
    return results.withColumn("efficiency", F.col(score) / (F.col(seconds) + F.lit(1.0)))


def best_by_score_and_efficiency(results: DataFrame, key: str, score: str = "mean_test_score",
                                 seconds: str = "mean_fit_time") -> DataFrame:
    """Two rows: the run with the best score, and the run with the best score per second."""
    from shelfscope.operators.clean import first_per_key

    scored = with_efficiency(results, score, seconds)
    ranked = scored.select("*", F.inline(F.array(
        F.struct(F.lit("score").alias("criterion"), F.col(score).alias("_v")),
        F.struct(F.lit("efficiency").alias("criterion"), F.col("efficiency").alias("_v")))))
    return first_per_key(ranked, "criterion", [F.desc("_v"), F.asc(key)]).select(
        "criterion", key, score, seconds, "efficiency")


def long_f1(comparison: DataFrame) -> DataFrame:
    """F1 at the default and at the tuned threshold in long form."""
    return comparison.unpivot(["name"], ["f1", "f1_at_best"], "kind", "value")
