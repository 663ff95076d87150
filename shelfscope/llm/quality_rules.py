"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Each whole text gets statistics as Spark expressions.
2. A small forest is grown on labelled training rows. Every path from a root to a node is a
   conjunction of comparisons: a rule.
3. A lasso logistic regression over the rules leaves few with a weight.
4. These compile to one Spark column, which scores all rows without Python.

At most about `fit_rows` labelled rows (by hash of the id) fit the model; the statistics
and the scores cover every row. Null or empty text: all statistics are 0, and it is
scored as such. Labels: the smallest of repeated ones. No labelled training row, or one
class only: no rule, the score is the (smoothed) share of label 1. Repeated rows: each is
scored. Null doc_id: held out, scored. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Scratch, stored


@dataclass(frozen=True)
class RuleParameters:
    trees: int = 24
    depth: int = 3
    lasso: float = 0.002
    rounds: int = 60
    fit_rows: int = 50_000
    seed: int = 5


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; `words` and `lines` stand for columns of the same name."""
    chars = F.greatest(F.length(text), F.lit(1))
    of = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / chars
    n_words, n_lines = F.greatest(F.size("words"), F.lit(1)), F.greatest(F.size("lines"), F.lit(1))
    return {
        "log_words": F.log1p(F.size("words").cast("double")),
        "letters": of(r"\P{L}+"),
        "capitals": of(r"\P{Lu}+"),
        "digits": of(r"\P{N}+"),
        "symbols": of(r"[\p{L}\p{N}\s]+"),
        "mean_word": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct("words")) / n_words,
        "distinct_lines": F.size(F.array_distinct("lines")) / n_lines,
        "log_line_words": F.log1p(F.size("words") / n_lines),
    }


NAMES = [
    "log_words", "letters", "capitals", "digits", "symbols", "mean_word", "distinct_words", "distinct_lines", "log_line_words"]


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.withColumn("words", F.filter(F.split(text, r"\s+"), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split(text, r"[\r\n]+"), lambda x: x != ""))
    return split.withColumns(statistics(text)).drop("words", "lines")


Rule = tuple[tuple[int, str, float], ...]


def paths(forest: str) -> list[Rule]:
    """Every root-to-node path of the forest's description, as comparisons (feature, sign, threshold)."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[int, str, float]]] = []
    for line in forest.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            stack = [s for s in stack if s[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            found[tuple(s[1] for s in stack)] = None
        elif "Tree" in line:
            stack = []
    return list(found)


def as_column(rule: Rule, names: list[str]) -> Column:
    held = F.lit(True)
    for feature, sign, threshold in rule:
        value = F.col(names[feature])
        held = held & (value <= F.lit(threshold) if sign == "<=" else value > F.lit(threshold))
    return held


def score_column(model: dict) -> Column:
    """The model as one expression over the statistics."""
    total = F.lit(float(model["intercept"]))
    for rule, weight in model["rules"]:
        total = total + F.when(as_column(rule, NAMES), F.lit(float(weight))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, p: RuleParameters, keep: Scratch) -> dict:
    """The rules with a weight, from rows of statistics and `label`."""
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0
    prior = math.log((ones + 1.0) / (n - ones + 1.0))
    if not ones or ones == n:
        return {"rules": [], "intercept": prior}
    part = F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1_000_000)) < min(1_000_000, math.ceil(1e6 * p.fit_rows / n))
    chosen = keep.stored(rows.where(part).select(array_to_vector(F.array(*NAMES)).alias("features"), F.col("label").cast("double"), *NAMES))
    if chosen.select("label").distinct().count() < 2:
        return {"rules": [], "intercept": prior}
    forest = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="onethird").fit(chosen)
    rules = paths(forest.toDebugString)
    if not rules:
        return {"rules": [], "intercept": prior}
    held = F.array(*[as_column(r, NAMES).cast("double") for r in rules])
    ruled = keep.stored(chosen.select(array_to_vector(held).alias("features"), "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=p.lasso, maxIter=p.rounds).fit(ruled)
    weights = lasso.coefficients.toArray()
    return {"rules": [(r, w) for r, w in zip(rules, weights, strict=True) if w], "intercept": lasso.intercept}


def scored(docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
           label_column: str = "quality", p: RuleParameters = RuleParameters()) -> DataFrame:
    """doc_id, score, predicted of every row; labels of rows where `train` holds are learned from."""
    with Scratch(docs.sparkSession, "quality") as keep:
        narrow = docs.select(F.col(id_column).alias("doc_id"), train.alias("_train"), F.col(text_column).alias("text"))
        table = stored(with_statistics(narrow).drop("text"), "statistics")
        known = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.min(label_column).alias("label")).where("label is not null")
        rows = keep.stored(table.where("_train").join(known, "doc_id"))
        model = fit(rows, p, keep)
    score = score_column(model)
    return table.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
