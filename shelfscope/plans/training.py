"""Sweep the experiments of a task, gate the best run and keep the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators import gate, metrics, models
from shelfscope.sources.tables import load_split, write_json


def train_task(spark: SparkSession, splits: str, task: str, columns: Sequence[str], champions: DataFrame, out: str,
               metric: str = "pr_auc", minimum: float | None = 0.25, effort: models.Effort = models.FULL,
               ml_only: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(comparison, decision): every run's metrics, and what the gate says of the best one.

    The comparison goes to JSON, all models to ``out``; the champions table is the caller's
    to replace by ``gate.new_champions``.
    """
    rows, label = load_split(spark, splits, task), f"target_{task}"
    runs, fitted = models.sweep(
        rows.where("split = 'train'"), rows.where("split = 'test'"), label, "appid", columns,
        models.choose(models.EXPERIMENTS, ml_only), effort, seed)
    write_json(runs, f"{out}/comparison_{task}")
    comparison = spark.read.schema(runs.schema).json(f"{out}/comparison_{task}").withColumn("task", F.lit(task))
    for name, model in fitted.items():
        model.write().overwrite().save(f"{out}/models/{task}/{name}")
    decision = gate.gate(metrics.best_run(comparison, metric), champions, metric, minimum)
    return comparison, decision
