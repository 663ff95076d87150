"""Spark ML classifiers, the experiment sweep, tuning, and scoring."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import scalars as X
from shelfscope.operators import forests, model_tables, perceptrons
from shelfscope.operators.metrics import binary_metrics
from shelfscope.operators.skew import class_sizes
from shelfscope.operators.smote import smote
from shelfscope.operators.split import Scaler, class_draw_rank
from shelfscope.session import stored


@dataclass(frozen=True)
class Effort:
    """Sizes of the fitted models."""

    trees: int = 300
    rounds: int = 300
    mlp_iterations: int = 400
    forest_depth: int = 12
    boost_depth: int = 6
    boost_rate: float = 0.1


FULL = Effort()
QUICK = Effort(trees=100, rounds=100, mlp_iterations=100)


# --- inputs ----------------------------------------------------------------

def class_counts(df: DataFrame, label: str) -> dict[float, int]:
    return {float(c): n for c, n in class_sizes(df, label).items()}


def weighted(df: DataFrame, label: str, weights: Mapping[float, float]) -> DataFrame:
    value = F.lit(1.0)
    for c, w in weights.items():
        value = F.when(F.col(label) == c, F.lit(float(w))).otherwise(value)
    return df.withColumn("weight", value)


def balanced_weights(df: DataFrame, label: str) -> dict[float, float]:
    """n / (classes x n_class)."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    return {c: n / (len(counts) * m) for c, m in counts.items()}


def positive_weights(df: DataFrame, label: str) -> dict[float, float]:
    """Positives weigh negatives / positives."""
    counts = class_counts(df, label)
    return {0.0: 1.0, 1.0: counts.get(0.0, 0) / max(counts.get(1.0, 0), 1)}


#: Rows that a task of a fit has at least, by estimator (others: ``FEW_ROWS``), and at most.
LEAST_ROWS = {"forest": 2_000, "perceptron": 1_000}
FEW_ROWS, GRID_ROWS, MOST_ROWS = 20_000, 20_000, 2_000_000
#: Trees that a fit of the grid grows at once.
GRID_TREES = 50
#: Rows up to which a forest, or a perceptron, is left to Spark's own fit.
FOREST_ROWS = PERCEPTRON_ROWS = 50_000


def dealt(df: DataFrame, least: int) -> DataFrame:
    """The rows dealt evenly over the tasks of a fit: ``least`` rows or more to each, and no more tasks than cores.

    A fit runs thousands of short jobs. Each of their tasks has a fixed cost, and each task of a tree's level hands on
    the statistics of all open nodes, however few its rows are."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, n // least), math.ceil(n / MOST_ROWS)))


def assembled(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)
    return out if label is None else out.withColumn("label", F.col(label).cast("double"))


# --- estimators ------------------------------------------------------------

def logistic(seed: int, effort: Effort, width: int):
    return LogisticRegression(maxIter=1000, tol=1e-4, weightCol="weight", standardization=False)


def forest(seed: int, effort: Effort, width: int):
    """The node that a row has reached in each tree is kept between levels: 4 bytes a row and tree, and no tree is sent to
    the tasks or walked from its root again for every row at every level."""
    return RandomForestClassifier(numTrees=effort.trees, maxDepth=effort.forest_depth, seed=seed, weightCol="weight", cacheNodeIds=True)


def boosted(seed: int, effort: Effort, width: int):
    return GBTClassifier(maxIter=effort.rounds, maxDepth=effort.boost_depth, stepSize=effort.boost_rate, seed=seed, weightCol="weight")


def perceptron(seed: int, effort: Effort, width: int):
    return MultilayerPerceptronClassifier(layers=[width, 128, 64, 2], maxIter=effort.mlp_iterations, seed=seed)


@dataclass(frozen=True)
class Experiment:
    name: str
    family: str
    estimator: Callable
    weights: Callable[[DataFrame, str], dict[float, float]] | None = None
    smote: bool = False


EXPERIMENTS = (
    Experiment("logistic_balanced", "ML", logistic, balanced_weights),
    Experiment("forest_balanced", "ML", forest, balanced_weights),
    Experiment("boosted_weighted", "ML", boosted, positive_weights),
    Experiment("boosted_smote", "ML", boosted, None, smote=True),
    Experiment("boosted_balanced", "ML", boosted, balanced_weights),
    Experiment("perceptron_raw", "DL", perceptron),
    Experiment("perceptron_smote", "DL", perceptron, None, smote=True),
)


def choose(experiments: Sequence[Experiment], ml_only: bool = False) -> list[Experiment]:
    return [e for e in experiments if not ml_only or e.family == "ML"]


def fit(experiment: Experiment, train: DataFrame, label: str, columns: Sequence[str], effort: Effort, seed: int) -> Model:
    weights = experiment.weights(train, label) if experiment.weights else {}
    ready = dealt(assembled(weighted(train, label, weights), columns, label).select("features", "label", "weight"),
                  LEAST_ROWS.get(experiment.estimator.__name__, FEW_ROWS)).persist()
    estimator = experiment.estimator(seed, effort, len(columns))
    try:
        if experiment.estimator is forest and ready.count() > FOREST_ROWS:
            return forests.fitted(estimator, ready, len(columns)) or estimator.fit(ready)
        if experiment.estimator is perceptron and ready.count() > PERCEPTRON_ROWS:
            return perceptrons.fitted(estimator, ready)
        return estimator.fit(ready)
    finally:
        ready.unpersist()


def scores(model: Model, df: DataFrame, columns: Sequence[str], out: str = "score") -> DataFrame:
    """The rows with the model's probability of class 1."""
    made = model.transform(assembled(df, columns))
    return made.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, out)


def sweep(train: DataFrame, test: DataFrame, label: str, key: str, columns: Sequence[str],
          experiments: Sequence[Experiment] = EXPERIMENTS, effort: Effort = FULL, seed: int = 42) -> tuple[DataFrame, dict[str, Model]]:
    """Fit every experiment and judge all of them on ``test`` in one aggregate.

    Gives (name, family, run_id, smote, metrics..., train_s) and the models by name. The
    train rows are persisted over the fits, and the oversampled rows are made once.
    """
    train = train.select(key, label, *columns).persist()
    larger = smote(train, label, key, columns, seed=seed).select(key, label, *columns).persist() if any(
        e.smote for e in experiments) else None
    models, facts, judged = {}, [], None
    try:
        for e in experiments:
            started = time.monotonic()
            models[e.name] = fit(e, larger if e.smote else train, label, columns, effort, seed)
            seconds = round(time.monotonic() - started, 1)
            run_id = uuid.uuid4().hex[:12]  # a model trained again is another run
            facts.append((e.name, e.family, run_id, e.smote, seconds))
            rows = scores(models[e.name], test, columns).select(F.lit(e.name).alias("name"), label, "score")
            judged = rows if judged is None else judged.unionByName(rows)
        judged = stored(judged, "judged")  # the metrics read the scores several times
        metrics = binary_metrics(judged, label, "score", ("name",))
    finally:
        train.unpersist()
        if larger is not None:
            larger.unpersist()
    spark = test.sparkSession
    runs = spark.createDataFrame(facts, "name string, family string, run_id string, smote boolean, train_s double")
    return runs.join(metrics, "name"), models


# --- tuning ----------------------------------------------------------------

def grid_votes(df: DataFrame, label: str, key: str, columns: Sequence[str], depths: Sequence[int], trees: Sequence[int],
               folds: int = 5, seed: int = 42, at_once: int = 12) -> tuple[DataFrame, DataFrame]:
    """The judgement of every row by every point of the grid, each row by the fold that did not train on it.

    One forest per fold is grown, of the most trees and the greatest depth. A point is this
    forest with its first n trees cut at depth d, so a fold's rows walk it once for all points.
    Trees of a forest are independent, so it is grown in parts of ``GRID_TREES`` with seeds of
    their own: each part in one task, which holds the rows and judges those of its fold too, so
    that no tree leaves it; see ``forests``. Rows that a task cannot hold, or labels other than
    0 and 1, are left to Spark's fits, at most ``at_once`` of them at a time.
    Gives the stored votes (key, label, fold, votes: one per depth and number of trees, in this
    order), and (fold, point, seconds): the fitting time of the fold's parts in proportion to
    the nodes of the point's forest.
    """
    depths, trees = list(depths), list(trees)
    ranked = class_draw_rank(df.select(key, label, *columns), label, key, seed, "_rank")
    data = dealt(assembled(ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")), columns, label), 1).withColumn(
        "_row", F.monotonically_increasing_id()).persist()
    firsts = range(0, max(trees), GRID_TREES)
    parts = [(fold, first, RandomForestClassifier(numTrees=min(GRID_TREES, max(trees) - first), maxDepth=max(depths), seed=seed + fold + folds * part))
             for fold in range(folds) for part, first in enumerate(firsts)]
    try:
        rows = forests.ready_rows(data, "fold", "_row")
        cuts, n, labels = forests.summary(rows, len(columns), folds, parts[0][2].getMaxBins())
        if n * len(columns) <= forests.HELD_CELLS and forests.can_grow(parts[0][2], labels):
            votes, done = _votes_in_tasks(data, rows, cuts, label, key, columns, parts, depths, trees)
        else:
            votes, done = _votes_of_fits(data, label, key, columns, parts, depths, trees, at_once)
    finally:
        data.unpersist()
    return votes, df.sparkSession.createDataFrame(done, "fold int, point int, seconds double")


def _votes_in_tasks(data: DataFrame, rows: DataFrame, cuts: Sequence, label: str, key: str, columns: Sequence[str], parts: Sequence,
                    depths: list[int], trees: list[int]) -> tuple[DataFrame, list[tuple]]:
    """The votes, and (fold, point, seconds), of parts that are grown and judged in tasks."""
    said = stored(forests.judged(rows, len(columns), cuts, parts, depths, trees), "judged")  # grown once
    shares = [F.sum(F.when(F.col("tree") <= n, F.get("sums", F.lit(k)))) / n for k in range(len(depths)) for n in trees]
    votes = said.where("row >= 0").groupBy("row").agg(F.array(*[s > 0.5 for s in shares]).alias("votes"))
    votes = data.select(key, label, "fold", "_row").join(votes, F.col("_row") == F.col("row")).select(key, label, "fold", "votes")
    facts, done = said.where("row < 0").collect(), []  # one row for each run of trees
    for fold in sorted({fold for fold, *_ in parts}):
        mine = [r for r in facts if r["set"] == fold]
        seconds, nodes = sum(r["sums"][0] for r in mine), sum(r["sums"][1] for r in mine)
        for k, (d, n) in enumerate((d, n) for d in range(len(depths)) for n in trees):
            done.append((fold, k, seconds * sum(r["sums"][2 + d] for r in mine if r["tree"] <= n) / nodes))
    return stored(votes, "votes"), done


def _votes_of_fits(data: DataFrame, label: str, key: str, columns: Sequence[str], parts: Sequence, depths: list[int], trees: list[int],
                   at_once: int) -> tuple[DataFrame, list[tuple]]:
    """The votes, and (fold, point, seconds), of Spark's fits. The statistics of all open nodes move once per task of a fit, so
    many fits of few tasks cost less than one fit of many tasks; each takes its own rows from those held over all cores."""
    spark = data.sparkSession

    def grown(fold: int, first: int, estimator) -> tuple[pa.Table, float]:
        started = time.monotonic()
        rows = dealt(data.where(F.col("fold") != fold), GRID_ROWS).sortWithinPartitions(key)
        model = estimator.fit(rows)
        seconds = time.monotonic() - started
        nodes = model_tables.model_table(model, spark).withColumn("tree", F.col("tree") + F.lit(first))
        return nodes.toArrow(), seconds  # as large as the fitted model on the driver

    def judged(fold: int, fits: Sequence) -> tuple[DataFrame, list[tuple]]:
        done = [p.result() for p in fits]
        forest_, seconds = model_tables.Trees(pa.concat_tables([nodes for nodes, _ in done])), sum(s for _, s in done)
        tree = np.repeat(np.arange(max(trees)), np.diff(forest_.roots, append=len(forest_.depth)))
        shares = [float(((forest_.depth <= d) & (tree < n)).mean()) for d in depths for n in trees]
        rows = model_tables.cut_votes(data.where(F.col("fold") == fold), columns, forest_, depths, trees, "votes")
        return stored(rows.select(key, label, "fold", "votes"), "votes"), [(fold, k, seconds * s) for k, s in enumerate(shares)]

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        fits: dict = {}
        for part in parts:
            fits.setdefault(part[0], []).append(pool.submit(grown, *part))
        done = [judged(fold, fits.pop(fold)) for fold in list(fits)]  # a fold's nodes are let go once its rows are judged
    return reduce(DataFrame.unionByName, (v for v, _ in done)), [r for _, rows in done for r in rows]


def grid_scores(votes: DataFrame, seconds: DataFrame, label: str, depths: Sequence[int], trees: Sequence[int]) -> DataFrame:
    """(max_depth, n_estimators, mean_test_score, mean_fit_time) of stored votes: recall of class 1, averaged over the folds.
    A fold without class 1 has a recall of 0."""
    positive, hit = F.col(label) == 1, F.col("vote")
    per_fold = votes.select("fold", label, F.posexplode("votes").alias("point", "vote")).groupBy("fold", "point").agg(
        F.count_if(positive & hit).alias("tp"), F.count_if(positive).alias("p"))
    recall = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))
    points = votes.sparkSession.createDataFrame(
        [(k, d, n) for k, (d, n) in enumerate((d, n) for d in depths for n in trees)], "point int, max_depth int, n_estimators int")
    return per_fold.join(F.broadcast(seconds), ["fold", "point"]).groupBy("point").agg(
        F.avg(recall).alias("mean_test_score"), F.avg("seconds").alias("mean_fit_time")).join(
        F.broadcast(points), "point").select("max_depth", "n_estimators", "mean_test_score", "mean_fit_time")


def grid_search(df: DataFrame, label: str, key: str, columns: Sequence[str], depths: Sequence[int], trees: Sequence[int],
                folds: int = 5, seed: int = 42) -> DataFrame:
    """Recall of class 1 over stratified folds at every point of depths x trees, with fitting times; see ``grid_votes``."""
    votes, seconds = grid_votes(df, label, key, columns, depths, trees, folds, seed)
    return grid_scores(votes, seconds, label, depths, trees)


def log_loss(scored: DataFrame, label: str, score: str = "score") -> float:
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    return scored.agg(F.avg(loss)).first()[0]


def perceptron_by_validation(train: DataFrame, valid: DataFrame, label: str, columns: Sequence[str], epochs: int = 15,
                             step: int = 10, hidden: Sequence[int] = (256, 64), seed: int = 42) -> tuple[Model, list[float]]:
    """A perceptron trained in short runs, each going on from the last weights; the model
    with the least validation loss is kept."""
    ready = dealt(assembled(train, columns, label).select("features", "label"), LEAST_ROWS["perceptron"]).persist()
    valid = valid.select(label, *columns).persist()
    best, losses, weights = None, [], None
    try:
        for _ in range(epochs):
            estimator = MultilayerPerceptronClassifier(layers=[len(columns), *hidden, 2], maxIter=step, seed=seed)
            if weights is not None:
                estimator.setInitialWeights(weights)
            model = estimator.fit(ready)
            weights = model.weights
            losses.append(log_loss(scores(model, valid, columns), label))
            if losses[-1] == min(losses):
                best = model
    finally:
        ready.unpersist()
        valid.unpersist()
    return best, losses


def importances(model: Model, columns: Sequence[str], spark, n: int = 15) -> DataFrame:
    """The n most important features of a fitted tree model."""
    return model_tables.table_importances(model_tables.model_table(model, spark), columns, n)


# --- hypothetical products -------------------------------------------------

def product_features(specs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature rows of planned products: price, release month and year, ``platforms`` and
    ``genres`` as arrays, and any feature column given directly. Features not derivable are 0."""
    given = set(specs.columns)
    derived = {
        "is_free": (F.col("price") == 0).cast("int"),
        "log_price": F.log1p("price"),
        "n_platforms": F.size("platforms"),
        "n_genre": F.size("genres"),
        "month_sin": F.sin(F.col("release_month") * F.lit(2 * 3.141592653589793) / 12),
        "month_cos": F.cos(F.col("release_month") * F.lit(2 * 3.141592653589793) / 12),
        "is_q4_release": F.col("release_month").isin(10, 11, 12).cast("int"),
        **{p: F.array_contains("platforms", p).cast("int") for p in ("windows", "mac", "linux")},
    }

    def value(c: str):
        if c in given:
            return F.col(c)
        if c in derived:
            return derived[c]
        if c.startswith("genre_"):
            return F.array_contains(F.transform("genres", X.safe_name), c.removeprefix("genre_")).cast("int")
        return F.lit(0)
    kept = [c for c in specs.columns if c not in columns and c not in ("platforms", "genres")]
    return specs.select(*kept, *[F.coalesce(value(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def score_products(specs: DataFrame, columns: Sequence[str], scaler: Scaler, model: Model) -> DataFrame:
    """Planned products scored by a model with a table form."""
    rows = scaler.transform(product_features(specs, columns))
    table = model_tables.model_table(model, specs.sparkSession)
    return model_tables.table_scores(rows, columns, table, model_tables.kind_of(model), "probability")
