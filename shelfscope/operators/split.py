"""Seeded splits, class balancing and scaling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.skew import MAX_CLASSES, class_sizes, draw_cutoffs, draw_order, draw_rank, of_value


def class_draw_rank(df: DataFrame, label: str, key: str, seed: int, out: str = "class_rank") -> DataFrame:
    """Rank of each row within its class, in a seeded order that is stable across runs."""
    drawn = df.withColumn("_draw", draw_order(key, seed))
    return draw_rank(drawn, label, "_draw", out).drop("_draw")


def _taken(df: DataFrame, want: Mapping, label: str, key: str, seed: int) -> Column:
    """True for the first ``want`` rows of each class in draw order: a comparison with one
    stored value per class, so that the rows themselves are neither joined nor shuffled."""
    draw = draw_order(key, seed)
    taken = F.lit(False)
    for c, cutoff in draw_cutoffs(df, want, label, draw).items():
        taken = F.when(of_value(F.col(label), c), draw <= F.lit(cutoff)).otherwise(taken)
    return taken


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     names: tuple[str, str] = ("train", "test"), max_classes: int = MAX_CLASSES) -> DataFrame:
    """Adds ``split``; each class gives round(test_size * n) rows to the second name.

    Rows without a label are a class of their own. ``key`` must be unique, since equal
    keys have equal draws.

    ``df`` is read three times to fit the cut-offs and should be a stored table.
    """
    want = {c: math.floor(n * test_size + 0.5) for c, n in class_sizes(df, label, max_classes).items()}
    return df.withColumn("split", F.when(_taken(df, want, label, key, seed), names[1]).otherwise(names[0]))


def downsample(df: DataFrame, label: str, key: str, seed: int = 42, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement, in one filter.

    Rows without a label are a class of their own; ``key`` must be unique.
    """
    sizes = class_sizes(df, label, max_classes)
    return df.where(_taken(df, dict.fromkeys(sizes, min(sizes.values(), default=0)), label, key, seed))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a constant column divides by one."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> "Scaler":
        stats = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns)
                 for p, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = train.agg(*stats).first()
        return cls(
            {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
            {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
        )

    @property
    def columns(self) -> list[str]:
        return list(self.mean)

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.columns}
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])

    def to_table(self, spark) -> DataFrame:
        rows = [(c, self.mean[c], self.std[c]) for c in self.columns]
        return spark.createDataFrame(rows, "feature string, mean double, std double")

    @classmethod
    def from_table(cls, table: DataFrame) -> "Scaler":
        """The table has one row per feature."""
        rows = table.collect()
        return cls({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows})


def impute_early_years(df: DataFrame, year: str, fit_on: DataFrame | None = None, floor: int = 2000,
                       default: float = 2018.0) -> DataFrame:
    """Years under ``floor`` become the median of the fit rows' years above it.

    Years are few, so the median is taken over their counts.
    """
    valid = (fit_on if fit_on is not None else df).where(F.col(year) > floor)
    per_year = valid.groupBy(F.col(year).cast("double").alias("y")).agg(F.count("*").alias("c"))
    median = per_year.agg(F.expr("percentile(y, 0.5, c)").alias("m")).first()["m"]
    value = F.lit(default if median is None else median)
    return df.withColumn(year, F.when(F.col(year) < floor, value).otherwise(F.col(year).cast("double")))
