"""Rating-pattern screen: five signals and an isolation forest (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.functions import scalars as X
from shelfscope.operators.skew import draw_sample, exact_quantile
from shelfscope.session import spread, stored

SIGNALS = ("log_reviews", "rev_per_owner", "positive_ratio", "rec_per_review", "log_price")
_PREFIX = "_sig_"
_NODES = "tree int, node int, feature int, threshold double, depth double"


def _reviews_per_owner(cfg: CatalogConfig):
    return F.col("total_reviews_calc") / X.owners_mid("estimated_owners", cfg.owners_mid_floor)


def signal_columns(cfg: CatalogConfig, per_owner_cap: float | None) -> dict:
    """The signals by name; nulls become 0."""
    reviews = F.col("total_reviews_calc").cast("double")
    signals = {
        "log_reviews": F.log1p(reviews),
        "rev_per_owner": X.clip(_reviews_per_owner(cfg), upper=per_owner_cap),
        "positive_ratio": F.try_divide(F.col("positive").cast("double"), reviews),
        "rec_per_review": X.clip(
            F.try_divide(F.coalesce(F.col("recommendations"), F.lit(0)).cast("double"), reviews),
            upper=cfg.recommendations_per_review_max),
        "log_price": F.log1p("price"),
    }
    return {name: F.coalesce(value, F.lit(0.0)) for name, value in signals.items()}


def per_owner_cap(df: DataFrame, cfg: CatalogConfig) -> float | None:
    """Upper-quantile cap of reviews per owner, exact."""
    ratio = df.select(_reviews_per_owner(cfg).alias("r"))
    return exact_quantile(ratio, "r", cfg.reviews_per_owner_quantile)


def anomaly_signals(df: DataFrame, cfg: CatalogConfig, key: str = "appid") -> DataFrame:
    columns = signal_columns(cfg, per_owner_cap(df, cfg))
    return df.select(key, *[c.alias(name) for name, c in columns.items()])


def average_path(n) -> np.ndarray:
    """Mean unsuccessful-search depth of a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    inner = np.maximum(n - 1, 1)
    mean = 2 * (np.log(inner) + np.euler_gamma) - 2 * inner / np.maximum(n, 1)
    return np.where(n > 2, mean, np.where(n == 2, 1.0, 0.0))


def _draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers from 0 to 1 for a node's feature and threshold, from an md5, so that every engine draws alike."""
    text = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(text[:12], 16) / 2**48, int(text[12:24], 16) / 2**48


def _grow(sample: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """One tree as rows (node, feature, threshold, depth); node n has the children 2n and 2n + 1, leaves have feature -1."""
    nodes: list[tuple] = []
    pending = [(1, sample, 0)]
    while pending:
        name, rows, depth = pending.pop()
        varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else np.array([])
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append((name, -1, 0.0, depth + float(average_path(len(rows)))))
            continue
        which, where = _draws(seed, tree, name)
        feature = int(varied[int(which * len(varied))])
        values = rows[:, feature]
        threshold = float(values.min() + where * (values.max() - values.min()))
        goes_left = values <= threshold
        nodes.append((name, feature, threshold, 0.0))
        pending += [(2 * name, rows[goes_left], depth + 1), (2 * name + 1, rows[~goes_left], depth + 1)]
    return nodes


class IsolationForest:
    """A fitted forest: small node arrays, broadcast once and applied batch by batch."""

    def __init__(self, trees: list[dict[str, np.ndarray]], sample_size: int, limit: int):
        self.trees, self.sample_size, self.limit = trees, sample_size, limit

    @classmethod
    def fit(cls, signals: DataFrame, cfg: CatalogConfig, key: str = "appid") -> "IsolationForest":
        """The pool is bounded by trees x sample; each tree takes its rows from it by an md5 of key and tree, and is grown
        in its own task. Signals are rounded to 9 digits, so that the tree does not depend on an engine's last bit."""
        pool_size, seed = cfg.anomaly_trees * cfg.anomaly_sample, cfg.seed
        drawn = draw_sample(signals, key, seed, pool_size).select(key, *[F.round(c, 9).alias(c) for c in SIGNALS])
        pool = stored(drawn, "forest-pool")
        n = pool.count()
        size = min(cfg.anomaly_sample, n)
        limit = max(1, math.ceil(math.log2(max(size, 2))))
        draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), "tree", F.lit(seed).cast("string")))
        dealt = spread(pool).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(cfg.anomaly_trees - 1)))).withColumn("_d", draw)
        if n > 8 * size:
            # four times the rows that a tree takes; the chance that so few pass is below 1e-100
            dealt = dealt.where(F.col("_d") < format(int(4 * size / n * 16**12), "012x"))
        place = F.row_number().over(W.partitionBy("tree").orderBy("_d", key))
        own = dealt.withColumn("_place", place).where(F.col("_place") <= size)

        def grow(rows: pa.Table) -> pa.Table:
            tree = rows["tree"][0].as_py()
            sample = np.column_stack([rows[c].to_numpy() for c in SIGNALS])
            columns = list(zip(*_grow(sample, seed, tree, limit), strict=True))
            kinds = pa.int32(), pa.int32(), pa.float64(), pa.float64()
            arrays = [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)]
            return pa.Table.from_arrays([pa.array([tree] * len(arrays[0]), pa.int32()), *arrays], ["tree", "node", "feature", "threshold", "depth"])

        nodes = own.select("tree", *SIGNALS).groupBy("tree").applyInArrow(grow, _NODES).toPandas()
        trees = []
        for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
            own_ids = np.arange(2 << limit)
            made = {"feature": np.full(len(own_ids), -1), "threshold": np.zeros(len(own_ids)), "depth": np.zeros(len(own_ids))}
            for c in made:
                made[c][t["node"]] = t[c]
            inner = made["feature"] >= 0
            trees.append(made | {"left": np.where(inner, 2 * own_ids, own_ids), "right": np.where(inner, 2 * own_ids + 1, own_ids)})
        return cls(trees, size, limit)

    def scorer(self, spark):
        """A vectorised column function over the signal columns: 2 ** (-mean depth / c(sample))."""
        shared = spark.sparkContext.broadcast(self.trees)
        limit, scale = self.limit, max(float(average_path(self.sample_size)), 1e-12)

        @F.pandas_udf("double")
        def score(*signals: pd.Series) -> pd.Series:
            rows = np.round(np.column_stack([s.to_numpy(float) for s in signals]), 9)
            at = np.arange(len(rows))
            depth = np.zeros(len(rows))
            for t in shared.value:
                node = np.ones(len(rows), dtype=np.int64)
                for _ in range(limit):
                    left = rows[at, np.maximum(t["feature"][node], 0)] <= t["threshold"][node]
                    node = np.where(left, t["left"][node], t["right"][node])
                depth += t["depth"][node]
            return pd.Series(np.round(2.0 ** (-depth / max(len(shared.value), 1) / scale), 9))

        return score


def screen(df: DataFrame, cfg: CatalogConfig, key: str = "appid") -> DataFrame:
    """Adds ``is_suspicious`` and ``anomaly_score``.

    Scores are written once, as a narrow table, to find the flag's cut-off. The result
    then scores rows in place, which is cheaper than a join of the wide table.
    """
    if not cfg.anomaly_enabled:
        return df.withColumns({"is_suspicious": F.lit(0), "anomaly_score": F.lit(0.0)})
    columns = signal_columns(cfg, per_owner_cap(df, cfg))
    signals = df.select(key, *[c.alias(n) for n, c in columns.items()])
    score = IsolationForest.fit(signals, cfg, key).scorer(df.sparkSession)
    scores = stored(signals.select(score(*SIGNALS).alias("s")), "scores")
    cutoff = exact_quantile(scores, "s", 1 - cfg.contamination)
    held = {f"{_PREFIX}{n}": c for n, c in columns.items()}
    return (
        df.withColumns(held)
        .withColumn("anomaly_score", score(*[F.col(c) for c in held]))
        .withColumn("is_suspicious", (F.col("anomaly_score") > F.lit(cutoff)).cast("int"))
        .drop(*held)
    )
