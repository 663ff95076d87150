"""Classifier metrics, gating, quality checks, models, anomaly flags and oversampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from catalog_queries.base import CFG, LABELLED, cleaned, games, items, labelled, query, stored_labels, table
from catalog_queries.shaping import r6
from shelfscope.config import CatalogConfig
from shelfscope.functions.scalars import safe_column
from shelfscope.operators import (
    anomaly, clean, gate, labels, metrics, model_tables, models, neighbours, quality, reports, smote, split)
from shelfscope.operators.features import engineer, feature_columns, leakage_guard
from shelfscope.session import checkpointed, stored

# --- metrics ---------------------------------------------------------------

# a score in 0..1 for every judged document, by language
_SCORED = """
scored AS (SELECT lang, quality AS y, round(n_chars / (n_chars + 1500.0 + 400.0 * (doc_id % 7)), 3) AS s FROM documents JOIN labels USING (doc_id))"""
_CURVE = _SCORED + """,
g AS (SELECT lang, s, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM scored GROUP BY ALL),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(n) OVER w AS BIGINT) AS cum_n,
    CAST(sum(pos) OVER (PARTITION BY lang) AS BIGINT) AS all_pos, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS all_n
  FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC)),
f AS (SELECT *, cum_pos / cum_n AS p, COALESCE(cum_pos / all_pos, 0.0) AS r FROM c),
f1 AS (SELECT *, 2.0 * p * r / GREATEST(p + r, 1e-9) AS f1 FROM f)"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1500.0) + F.lit(400.0) * (F.col("doc_id") % 7))
    return docs.select("lang", F.col("quality").alias("y"), F.round(score, 3).alias("s"))


@query("score_curve", "W2", "WITH " + _CURVE + "\nSELECT lang, s AS score, pos, n, cum_pos, cum_n, all_pos, all_n FROM c")
def score_curve(spark, sf):
    return metrics.score_curve(_scored(spark, sf), "y", "s", ("lang",))


@query("binary_metrics", "M10 M11 M12 M13 W2", "WITH " + _CURVE + """,
cut AS (SELECT lang, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5) AS pp, count(*) FILTER (y = 1) AS p FROM scored GROUP BY lang),
best AS (SELECT lang, s, f1 FROM f1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1.f1 DESC, s) = 1)
SELECT f1.lang, any_value(all_n) AS rows, any_value(all_pos) AS positives, round(sum(COALESCE(f1.pos / all_pos, 0.0) * f1.p), 6) + 0.0 AS pr_auc,
  round(sum((n - pos) * (cum_pos - pos / 2.0)) / NULLIF(any_value(all_pos) * (any_value(all_n) - any_value(all_pos)), 0), 6) + 0.0 AS roc_auc,
  round(any_value(COALESCE(cut.tp / cut.pp, 0.0)), 6) + 0.0 AS precision, round(any_value(COALESCE(cut.tp / cut.p, 0.0)), 6) + 0.0 AS recall,
  round(any_value(COALESCE(2.0 * cut.tp / (cut.pp + cut.p), 0.0)), 6) + 0.0 AS f1,
  any_value(best.s) AS best_threshold, round(any_value(best.f1), 6) + 0.0 AS f1_at_best
FROM f1 JOIN cut ON cut.lang = f1.lang JOIN best ON best.lang = f1.lang GROUP BY f1.lang""")
def binary_metrics(spark, sf):
    made = metrics.binary_metrics(_scored(spark, sf), "y", "s", ("lang",))
    return made.withColumns({c: r6(c) for c in ("pr_auc", "roc_auc", "precision", "recall", "f1", "f1_at_best")})


@query("classification_report", "M14", "WITH " + _SCORED + """,
t AS (SELECT CAST(y AS VARCHAR) AS a, CASE WHEN s >= 0.5 THEN '1' ELSE '0' END AS p FROM scored),
k AS (SELECT a AS c FROM t UNION SELECT p FROM t),
m AS (SELECT c, count(*) FILTER (a = c AND p = c) AS tp, count(*) FILTER (p = c) AS called, count(*) FILTER (a = c) AS support FROM k, t GROUP BY c),
s AS (SELECT c, tp, support, COALESCE(tp / called, 0.0) AS pr, COALESCE(tp / support, 0.0) AS re, COALESCE(2.0 * tp / (called + support), 0.0) AS f FROM m)
SELECT c AS row, round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f1, support FROM s
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6) + 0.0, round(sum(tp) / sum(support), 6) + 0.0, round(sum(tp) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(pr), 6) + 0.0, round(avg(re), 6) + 0.0, round(avg(f), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6) + 0.0, round(sum(re * support) / sum(support), 6) + 0.0,
  round(sum(f * support) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM s""")
def classification_report(spark, sf):
    called = _scored(spark, sf).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    return metrics.classification_report(called, "y", "p").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


_RESULTS = """
res AS (SELECT CAST(l_suppkey AS BIGINT) AS run_id, avg(l_discount) AS mean_test_score, avg(l_quantity) AS mean_fit_time FROM lineitem GROUP BY 1),
eff AS (SELECT *, mean_test_score / (mean_fit_time + 1.0) AS efficiency FROM res)"""


@query("efficient_runs", "M8", "WITH " + _RESULTS + """
SELECT criterion, run_id, round(mean_test_score, 6) + 0.0 AS mean_test_score, round(mean_fit_time, 6) + 0.0 AS mean_fit_time, round(efficiency, 6) + 0.0 AS efficiency FROM (
  SELECT *, 'score' AS criterion FROM eff QUALIFY row_number() OVER (ORDER BY mean_test_score DESC, run_id) = 1
  UNION ALL SELECT *, 'efficiency' FROM eff QUALIFY row_number() OVER (ORDER BY efficiency DESC, run_id) = 1)""")
def efficient_runs(spark, sf):
    results = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("run_id")).agg(
        F.avg("l_discount").alias("mean_test_score"), F.avg("l_quantity").alias("mean_fit_time"))
    made = metrics.best_by_score_and_efficiency(results, "run_id")
    return made.withColumns({c: r6(c) for c in ("mean_test_score", "mean_fit_time", "efficiency")})


@query("long_f1", "A18", "WITH " + _CURVE + """,
cut AS (SELECT lang, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5) AS pp, count(*) FILTER (y = 1) AS p FROM scored GROUP BY lang)
SELECT lang AS name, 'f1' AS kind, round(COALESCE(2.0 * tp / (pp + p), 0.0), 6) + 0.0 AS value FROM cut
UNION ALL SELECT lang, 'f1_at_best', round(max(f1), 6) + 0.0 FROM f1 GROUP BY lang""")
def long_f1(spark, sf):
    made = metrics.binary_metrics(_scored(spark, sf), "y", "s", ("lang",)).withColumnRenamed("lang", "name")
    return metrics.long_f1(made).withColumn("value", r6("value"))


# --- gate and quality ------------------------------------------------------

_GATE = """
judged AS (SELECT concat_ws('-', COALESCE(lang, 'none'), COALESCE(source, 'none')) AS task, quality, toxic FROM documents JOIN labels USING (doc_id)),
runs AS (SELECT task, 'run-' || task AS run_id, avg(quality) AS pr_auc FROM judged GROUP BY 1),
champ AS (SELECT task, 'old-' || task AS run_id, avg(1 - toxic) AS value, CAST(count(*) AS INT) AS version FROM judged GROUP BY 1 HAVING sum(toxic) > 0),
dec AS (SELECT r.task, r.run_id, pr_auc AS value, c.value AS old_value, c.version AS old_version,
    CASE WHEN pr_auc < 0.85 THEN 'under minimum' WHEN pr_auc <= c.value THEN 'not above champion' WHEN c.value IS NULL THEN 'first champion' ELSE 'better than champion' END AS reason
  FROM runs r LEFT JOIN champ c USING (task)),
dec2 AS (SELECT *, reason IN ('first champion', 'better than champion') AS promoted FROM dec)"""


def _gate_tables(spark, sf):
    """One run per language and source, rated by quality; a champion where a label is toxic, rated by the others."""
    task = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")))
    judged = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(task.alias("task"), "quality", "toxic")
    runs = judged.groupBy("task").agg(F.avg("quality").alias("pr_auc"))
    champions = judged.groupBy("task").agg(
        F.avg(1 - F.col("toxic")).alias("value"), F.count("*").cast("int").alias("version"), F.sum("toxic").alias("_toxic"))
    return (runs.withColumn("run_id", F.concat(F.lit("run-"), "task")),
            champions.where("_toxic > 0").drop("_toxic").withColumn("run_id", F.concat(F.lit("old-"), "task")))


@query("gate_decisions", "M17", "WITH " + _GATE + """
SELECT task, run_id, round(value, 6) + 0.0 AS value, round(old_value, 6) + 0.0 AS old_value, promoted, reason,
  CASE WHEN promoted THEN COALESCE(old_version, 0) + 1 ELSE old_version END AS version FROM dec2""")
def gate_decisions(spark, sf):
    runs, champions = _gate_tables(spark, sf)
    return gate.gate(runs, champions, "pr_auc", 0.85).withColumns({"value": r6("value"), "old_value": r6("old_value")})


@query("new_champions", "M17", "WITH " + _GATE + """
SELECT task, run_id, round(value, 6) + 0.0 AS value, version FROM champ WHERE task NOT IN (SELECT task FROM dec2 WHERE promoted)
UNION ALL SELECT task, run_id, round(value, 6) + 0.0, COALESCE(old_version, 0) + 1 FROM dec2 WHERE promoted""")
def new_champions(spark, sf):
    runs, champions = _gate_tables(spark, sf)
    made = gate.new_champions(gate.gate(runs, champions, "pr_auc", 0.85), champions)
    return made.withColumn("value", r6("value"))


RULES = (("rows", 100.0, None), ("hit_rate", 0.05, 0.40), ("gem_rate", 0.05, 0.40), ("features", 50.0, 120.0), ("leakage_columns", 15.0, None))


@query("quality_checks", "F19 P1 P14", "WITH " + LABELLED + f""",
g AS (SELECT DISTINCT unnest({items('genres')}) AS i FROM labelled), t AS (SELECT DISTINCT unnest({items('tags')}) AS i FROM labelled),
meta AS (SELECT CAST(count(*) AS DOUBLE) AS rows, avg(target_hit) AS hit_rate, avg(target_hidden_gem) AS gem_rate,
    CAST(19 + (SELECT least(15, count(*)) FROM g) + (SELECT least(30, count(*)) FROM t) AS DOUBLE) AS features FROM labelled)
SELECT 'rows' AS "check", rows AS value, CAST(100.0 AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, rows >= 100 AS passed FROM meta
UNION ALL SELECT 'hit_rate', round(hit_rate, 6) + 0.0, 0.05, 0.40, hit_rate BETWEEN 0.05 AND 0.40 FROM meta
UNION ALL SELECT 'gem_rate', round(gem_rate, 6) + 0.0, 0.05, 0.40, gem_rate BETWEEN 0.05 AND 0.40 FROM meta
UNION ALL SELECT 'features', features, 50.0, 120.0, features BETWEEN 50 AND 120 FROM meta
UNION ALL SELECT 'leakage_columns', 4.0, 15.0, NULL, false FROM meta""")
def quality_checks(spark, sf):
    rows = stored_labels(spark, sf)
    guarded, leaked = leakage_guard(engineer(rows, CFG), CFG)
    meta = quality.run_metadata(
        labels.label_summary(rows, CFG), clean.cleaning_funnel(games(spark, sf), CFG, ["name"]),
        len(feature_columns(guarded, KEYS)), leaked, {"seed": str(CFG.seed)})
    return quality.quality_checks(meta, RULES).withColumn("value", r6("value"))


# --- models ----------------------------------------------------------------

EFFORT = models.FULL
BALANCED_EFFORT = models.Effort(rounds=500, boost_depth=8, boost_rate=0.05)
KEYS = ("appid", "short_description", "split", "name")


def _task(spark, sf, label):
    """Scaled train and test rows of a task, with the feature names and the scaler.

    The split is stored first, since fits read it many times.
    """
    known = stored(labelled(spark, sf).drop("short_description"))  # no feature is made of the text
    guarded, _ = leakage_guard(engineer(known, CFG), CFG)
    rows = stored(guarded)
    columns = feature_columns(rows, KEYS)
    parts = stored(split.stratified_split(rows, label, "appid", CFG.test_size, CFG.seed))
    scaler = split.Scaler.fit(parts.where("split = 'train'"), columns)
    scaled = scaler.transform(parts)
    return scaled.where("split = 'train'"), scaled.where("split = 'test'"), columns, scaler


def _sweep(spark, sf, names):
    train, test, columns, _ = _task(spark, sf, "target_hidden_gem")
    chosen = [e for e in models.EXPERIMENTS if e.name in names]
    runs, _ = models.sweep(train, test, "target_hidden_gem", "appid", columns, chosen, EFFORT, CFG.seed)
    return runs


@query("sweep_linear_and_forest", "M1 M2 M9 M10")
def sweep_linear_and_forest(spark, sf):
    return _sweep(spark, sf, ("logistic_balanced", "forest_balanced"))


@query("sweep_boosted_weighted", "M3 M9")
def sweep_boosted_weighted(spark, sf):
    return _sweep(spark, sf, ("boosted_weighted",))


@query("sweep_boosted_smote", "M3 M9 F17")
def sweep_boosted_smote(spark, sf):
    return _sweep(spark, sf, ("boosted_smote",))


@query("sweep_boosted_balanced", "M4 M9")
def sweep_boosted_balanced(spark, sf):
    return _sweep(spark, sf, ("boosted_balanced",))


@query("sweep_perceptrons", "M5 M9 F17")
def sweep_perceptrons(spark, sf):
    return _sweep(spark, sf, ("perceptron_raw", "perceptron_smote"))


def _balanced(spark, sf):
    train, test, columns, scaler = _task(spark, sf, "target_hit")
    return split.downsample(train, "target_hit", "appid", CFG.seed), test, columns


@query("validated_perceptron", "M6 M14 F16 F18")
def validated_perceptron(spark, sf):
    kept, test, columns = _balanced(spark, sf)
    parts = split.stratified_split(kept.drop("split"), "target_hit", "appid", 0.2, 7, ("train", "valid"))
    model, _ = models.perceptron_by_validation(
        parts.where("split = 'train'"), parts.where("split = 'valid'"), "target_hit", columns)
    called = models.scores(model, test, columns).withColumn("called", (F.col("score") >= 0.5).cast("int"))
    return metrics.classification_report(called, "target_hit", "called")


@query("boosted_on_balanced", "M4 M14 F16")
def boosted_on_balanced(spark, sf):
    kept, test, columns = _balanced(spark, sf)
    model = models.fit(models.Experiment("boosted_plain", "ML", models.boosted), kept, "target_hit", columns, BALANCED_EFFORT, CFG.seed)
    called = models.scores(model, test, columns).withColumn("called", (F.col("score") >= 0.5).cast("int"))
    return metrics.classification_report(called, "target_hit", "called")


#: The points and folds of the reference's search.
GRID = {"depths": [8, 12, 16, 20, 24], "trees": [100, 200, 300, 400, 500], "folds": 5}


@query("grid_search", "M7 M8")
def grid_search(spark, sf):
    train, _, columns, _ = _task(spark, sf, "target_hit")
    results = models.grid_search(train, "target_hit", "appid", columns, **GRID)
    return metrics.with_efficiency(results)


def _forest(spark, sf):
    train, test, columns, scaler = _task(spark, sf, "target_hidden_gem")
    experiment = next(e for e in models.EXPERIMENTS if e.name == "forest_balanced")
    return models.fit(experiment, train, "target_hidden_gem", columns, EFFORT, CFG.seed), columns, scaler


@query("feature_importances", "T8 M2")
def feature_importances(spark, sf):
    model, columns, _ = _forest(spark, sf)
    return model_tables.table_importances(model_tables.model_table(model, spark), columns)


@query("scored_catalog", "M15 J4")
def scored_catalog(spark, sf):
    """The fitted forest stored as a table, and all rows scored by the table."""
    train, test, columns, _ = _task(spark, sf, "target_hidden_gem")
    experiment = next(e for e in models.EXPERIMENTS if e.name == "forest_balanced")
    model = models.fit(experiment, train, "target_hidden_gem", columns, EFFORT, CFG.seed)
    table_ = model_tables.model_table(model, spark)
    scored = model_tables.table_scores(train.unionByName(test), columns, table_, model_tables.kind_of(model), "gem_score")
    return labelled(spark, sf).select("appid", "name", "price", "genres", "target_hidden_gem", "total_reviews_calc").join(
        scored.select("appid", "gem_score"), "appid")


@query("latent_gems", "T2 M15 J4 P11")
def latent_gems(spark, sf):
    facets = reports.catalog_facets(80, (), ())
    return reports.latent_gems(scored_catalog(spark, sf), facets, 30, 20)


@query("scored_products", "M16")
def scored_products(spark, sf):
    """Planned products: one for every part type and brand, priced at their mean."""
    model, columns, scaler = _forest(spark, sf)
    specs = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(
        F.round(F.avg("p_retailprice") - 900, 2).alias("price")).select(
        "p_type", "p_brand", "price", F.lit(6).alias("release_month"), F.lit(2000).alias("release_year"),
        F.array(F.lit("windows")).alias("platforms"), F.array("p_type").alias("genres"),
        F.lit(1).alias("is_self_published"))
    return models.score_products(specs, columns, scaler, model).select("p_type", "p_brand", "probability")


# A model table with one tree for each pair of columns: both are split at their means, and a leaf holds its class rate.
_PAIRED = ("price", "required_age", "recommendations")
_CELLS = LABELLED + """,
means AS (SELECT round(avg(price), 6) AS m0, round(avg(required_age), 6) AS m1, round(avg(recommendations), 6) AS m2 FROM labelled),
side AS (SELECT appid, target_hidden_gem AS y, price <= m0 AS l0, required_age <= m1 AS l1, recommendations <= m2 AS l2 FROM labelled, means),
long AS (SELECT 0 AS tree, appid, y, l0 AS a, l1 AS b FROM side UNION ALL SELECT 1, appid, y, l1, l2 FROM side
  UNION ALL SELECT 2, appid, y, l2, l0 FROM side),
cell AS (SELECT tree, a, b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM long GROUP BY ALL)"""


def _paired_trees(spark, sf):
    """The rows, and the trees as a model table."""
    # stored, since the means, the cells of each tree and the scores read them
    rows = stored(labelled(spark, sf).select("appid", F.col("target_hidden_gem").alias("y"), *[F.col(c).cast("double") for c in _PAIRED]))
    means = rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in _PAIRED]).first()
    low = {c: F.col(c) <= means[c] for c in _PAIRED}
    nodes = []
    for tree, (a, b) in enumerate(zip(_PAIRED, _PAIRED[1:] + _PAIRED[:1])):
        cells = {(r["a"], r["b"]): (r["n"], r["p"]) for r in rows.groupBy(low[a].alias("a"), low[b].alias("b")).agg(
            F.count("*").alias("n"), F.sum("y").alias("p")).collect()}  # four cells
        count = lambda *keys: tuple(sum(cells.get(k, (0, 0))[i] for k in keys) for i in (0, 1))
        impure = lambda n, p: 2 * p * (n - p) / n if n else 0.0
        sides = [[(left, lower) for lower in (True, False)] for left in (True, False)]

        def node(at, keys, column=None, left=None, right=None, parts=()):
            n, p = count(*keys)
            gain = (impure(n, p) - sum(impure(*count(*k)) for k in parts)) / n if column and n else None
            split_ = (_PAIRED.index(column), means[column], left, right) if column else (None,) * 4
            nodes.append((tree, 1.0, at, *split_, p / n if n else 0.0, gain, float(n)))

        node(0, sides[0] + sides[1], a, 1, 4, sides)
        for k, side in enumerate(sides):
            node(1 + 3 * k, side, b, 2 + 3 * k, 3 + 3 * k, [[key] for key in side])
            for j, key in enumerate(side):
                node(2 + 3 * k + j, [key])
    table_ = spark.createDataFrame(nodes, "tree int, weight double, node int, feature int, threshold double, left int, right int, "
                                          "value double, gain double, rows double")
    return rows, table_


@query("scored_by_table", "M15 J4", "WITH " + _CELLS + """
SELECT appid, round(avg(p / n), 6) + 0.0 AS gem_score FROM long JOIN cell USING (tree, a, b) GROUP BY appid""")
def scored_by_table(spark, sf):
    rows, trees = _paired_trees(spark, sf)
    return model_tables.table_scores(rows, _PAIRED, trees, "forest").select("appid", r6("score").alias("gem_score"))


@query("importances_of_table", "T8", "WITH " + _CELLS + """,
node AS (SELECT tree, a, sum(n) AS n, sum(p) AS p, sum(2 * p * (n - p) / n) AS parts FROM cell GROUP BY tree, a),
gains AS (
  SELECT (tree + 1) % 3 AS f, tree, sum(2 * p * (n - p) / n - parts) AS g FROM node GROUP BY tree
  UNION ALL SELECT tree, tree, 2 * sum(p) * (sum(n) - sum(p)) / sum(n) - sum(2 * p * (n - p) / n) FROM node GROUP BY tree),
shares AS (SELECT f, g / sum(g) OVER (PARTITION BY tree) AS share FROM gains)
SELECT list_extract(['price', 'required_age', 'recommendations'], CAST(f + 1 AS INT)) AS feature,
  round(sum(share) / (SELECT sum(share) FROM shares), 6) + 0.0 AS importance FROM shares GROUP BY f""")
def importances_of_table(spark, sf):
    _, trees = _paired_trees(spark, sf)
    return model_tables.table_importances(trees, _PAIRED).select("feature", r6("importance").alias("importance"))


_RATED = LABELLED + """,
judged AS (SELECT *, round(wilson_lb * 0.5 + positive_ratio * 0.5, 6) AS gem_score FROM labelled)"""


@query("latent_gems_by_rating", "T2 J4 P11", "WITH " + _RATED + """
SELECT appid, name, price, total_reviews_calc, gem_score + 0.0 AS gem_score FROM judged
WHERE price <= 80 AND target_hidden_gem = 0 AND total_reviews_calc < 30 ORDER BY judged.gem_score DESC, appid LIMIT 20""")
def latent_gems_by_rating(spark, sf):
    """The report over scores that are computed from columns and joined by key, as a model's are."""
    rows = labelled(spark, sf)
    scores = rows.select("appid", F.round(F.col("wilson_lb") * 0.5 + F.col("positive_ratio") * 0.5, 6).alias("gem_score"))
    scored = rows.select("appid", "name", "price", "genres", "target_hidden_gem", "total_reviews_calc").join(scores, "appid")
    top = reports.latent_gems(scored, reports.catalog_facets(80, (), ()), 30, 20)
    return top.select("appid", "name", "price", "total_reviews_calc", r6("gem_score").alias("gem_score"))


@query("product_features", "M16", """
WITH s AS (SELECT p_type, p_brand, round(avg(p_retailprice) - 900, 2) AS price FROM part GROUP BY 1, 2)
SELECT p_type, p_brand, round(price, 6) + 0.0 AS price, CASE WHEN price = 0 THEN 1.0 ELSE 0.0 END + 0.0 AS is_free, round(ln(1 + price), 6) + 0.0 AS log_price,
  CAST(2 AS DOUBLE) AS n_platforms, CAST(1 AS DOUBLE) AS n_genre, round(sin(2 * pi() * 11 / 12), 6) + 0.0 AS month_sin,
  round(cos(2 * pi() * 11 / 12), 6) + 0.0 AS month_cos, CAST(1 AS DOUBLE) AS is_q4_release, CAST(2000 AS DOUBLE) AS release_year,
  CAST(1 AS DOUBLE) AS windows, CAST(0 AS DOUBLE) AS mac, CAST(1 AS DOUBLE) AS linux, CAST(0 AS DOUBLE) AS n_tag,
  CAST(p_type = (SELECT min(p_type) FROM part) AS DOUBLE) AS genre_first FROM s""")
def product_features(spark, sf):
    """What a model is given for planned products; types are genres as written, with blanks and capitals."""
    parts = table(spark, sf, "part")
    first = "genre_" + safe_column(parts.agg(F.min("p_type")).first()[0])
    specs = parts.groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice") - 900, 2).alias("price")).select(
        "p_type", "p_brand", "price", F.lit(11).alias("release_month"), F.lit(2000).alias("release_year"),
        F.array(F.lit("windows"), F.lit("linux")).alias("platforms"), F.array("p_type").alias("genres"))
    columns = ["price", "is_free", "log_price", "n_platforms", "n_genre", "month_sin", "month_cos", "is_q4_release",
               "release_year", "windows", "mac", "linux", "n_tag", first]
    made = models.product_features(specs, columns).drop("release_month").withColumnRenamed(first, "genre_first")
    return made.withColumns({c: r6(c) for c in ("price", "log_price", "month_sin", "month_cos")})


# --- anomaly flags and oversampling ----------------------------------------

SCREEN = CFG.with_(anomaly_enabled=True, exclude_from_gem=True)



def _unit(text: str, first: int) -> str:
    """DuckDB: a number from 0 to 1 from 12 hexadecimal digits of an md5."""
    return f"(CAST('0x' || substr(md5({text}), {first}, 12) AS BIGINT) / 281474976710656.0)"


def _path(n: str) -> str:
    """DuckDB: the mean depth of an unsuccessful search among n keys."""
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {np.euler_gamma!r}) - 2 * ({n} - 1) / CAST({n} AS DOUBLE) WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"


def screened_sql(cfg: CatalogConfig) -> str:
    """DuckDB: the forest grown level by level from the same draws, and ``screened`` (appid, anomaly_score, is_suspicious)."""
    levels = max(1, math.ceil(math.log2(cfg.anomaly_sample)))
    text = f"'{cfg.seed}|' || tree || '|' || node"
    steps = [f"""
reach AS (SELECT *, total_reviews_calc / GREATEST((CAST(split_part(estimated_owners, ' - ', 1) AS DOUBLE)
    + CAST(split_part(estimated_owners, ' - ', 2) AS DOUBLE)) / 2, {cfg.owners_mid_floor}) AS r FROM cleaned),
sig AS (SELECT appid, [round(ln(1 + total_reviews_calc), 9), round(LEAST(r, (SELECT quantile_cont(r, {cfg.reviews_per_owner_quantile}) FROM reach)), 9),
    round(positive / total_reviews_calc, 9), round(LEAST(recommendations / total_reviews_calc, {cfg.recommendations_per_review_max}), 9), round(ln(1 + price), 9)] AS f FROM reach),
pool AS (SELECT * FROM sig ORDER BY md5(concat(appid, '|{cfg.seed}')) LIMIT {cfg.anomaly_trees * cfg.anomaly_sample}),
size AS (SELECT LEAST({cfg.anomaly_sample}, count(*)) AS size, GREATEST(1, ceil(log2(GREATEST(2, LEAST({cfg.anomaly_sample}, count(*)))))) AS deep FROM pool),
at0 AS MATERIALIZED (SELECT tree, f, 1 AS node FROM pool, range({cfg.anomaly_trees}) t(tree)
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5(concat_ws('|', appid, tree, {cfg.seed})), appid) <= (SELECT size FROM size))"""]
    for d in range(levels + 1):
        sides = ", ".join(f"min(f[{i}])" for i in range(1, 6)), ", ".join(f"max(f[{i}])" for i in range(1, 6))
        steps.append(f"""
seen{d} AS (SELECT tree, node, count(*) AS n, [{sides[0]}] AS lo, [{sides[1]}] AS hi FROM at{d} GROUP BY tree, node),
open{d} AS (SELECT *, CASE WHEN {d} >= (SELECT deep FROM size) THEN [] ELSE list_filter([1, 2, 3, 4, 5], lambda i: hi[i] > lo[i]) END AS wide FROM seen{d}),
split{d} AS (SELECT *, wide[1 + CAST(floor({_unit(text, 1)} * len(wide)) AS INT)] AS feature FROM open{d}),
node{d} AS MATERIALIZED (SELECT tree, node, feature, lo[feature] + {_unit(text, 13)} * (hi[feature] - lo[feature]) AS threshold,
    CASE WHEN feature IS NULL THEN {d} + {_path("n")} END AS depth FROM split{d}),
at{d + 1} AS MATERIALIZED (SELECT tree, f, 2 * node + CASE WHEN f[feature] <= threshold THEN 0 ELSE 1 END AS node FROM at{d} JOIN node{d} USING (tree, node) WHERE feature IS NOT NULL)""")
        source = f"(SELECT appid, f, tree, 1 AS node FROM sig, range({cfg.anomaly_trees}) t(tree))" if d == 0 else f"go{d}"
        steps.append(f"""
met{d} AS MATERIALIZED (SELECT w.appid, w.f, w.tree, w.node, m.feature, m.threshold, m.depth FROM {source} w LEFT JOIN node{d} m USING (tree, node)),
go{d + 1} AS (SELECT appid, f, tree, 2 * node + CASE WHEN f[feature] <= threshold THEN 0 ELSE 1 END AS node FROM met{d} WHERE feature IS NOT NULL)""")
    met = " UNION ALL ".join(f"SELECT appid, depth FROM met{d} WHERE feature IS NULL" for d in range(levels + 1))
    return ",".join(steps) + f""",
score AS (SELECT appid, round(pow(2.0, -sum(COALESCE(depth, 0)) / {cfg.anomaly_trees} / (SELECT {_path("size")} FROM size)), 9) AS anomaly_score FROM ({met}) GROUP BY appid),
screened AS (SELECT *, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, {1 - cfg.contamination!r}) FROM score) THEN 1 ELSE 0 END AS is_suspicious FROM score)"""


_SCREENED = LABELLED + "," + screened_sql(SCREEN)


@query("screened_catalog", "F3 F2", "WITH " + _SCREENED + "\nSELECT appid, is_suspicious, round(anomaly_score, 6) + 0.0 AS anomaly_score FROM screened")
def screened_catalog(spark, sf):
    made = anomaly.screen(stored(cleaned(spark, sf)), SCREEN)
    return made.select("appid", "is_suspicious", r6("anomaly_score").alias("anomaly_score"))


@query("labels_without_suspicious", "F1 F3", "WITH " + _SCREENED + """
SELECT count(*) AS rows, round(avg(target_hit), 6) + 0.0 AS hit_rate,
  round(avg(CASE WHEN target_hidden_gem = 1 AND is_suspicious = 0 THEN 1 ELSE 0 END), 6) + 0.0 AS gem_rate,
  count(*) FILTER (target_hidden_gem = 1 AND is_suspicious = 1) AS gems_excluded FROM labelled JOIN screened USING (appid)""")
def labels_without_suspicious(spark, sf):
    made = labels.label_summary(labels.make_labels(anomaly.screen(stored(cleaned(spark, sf)), SCREEN), SCREEN), SCREEN)
    return made.withColumns({"hit_rate": r6("hit_rate"), "gem_rate": r6("gem_rate")})


@query("suspicious_rows", "T3 F3", "WITH " + _SCREENED + """
SELECT appid, name, total_reviews_calc, round(positive_ratio, 6) + 0.0 AS positive_ratio, round(anomaly_score, 6) + 0.0 AS anomaly_score, price
FROM labelled JOIN screened USING (appid) WHERE is_suspicious = 1 ORDER BY screened.anomaly_score DESC, appid LIMIT 20""")
def suspicious_rows(spark, sf):
    made = labels.make_labels(anomaly.screen(stored(cleaned(spark, sf)), SCREEN), SCREEN)
    return reports.suspicious(made, 20).select(
        "appid", "name", "total_reviews_calc", r6("positive_ratio").alias("positive_ratio"), r6("anomaly_score").alias("anomaly_score"), "price")


_FLAGGED = LABELLED + """,
flagged AS (SELECT *, CASE WHEN recommendations * 100 > positive * 38 THEN 1 ELSE 0 END AS is_suspicious,
    round(CAST(recommendations AS DOUBLE) / positive, 6) AS anomaly_score FROM labelled)"""


def _flagged(spark, sf):
    """The catalog with a flag that is computed from columns, in place of the forest's."""
    flag = (F.col("recommendations") * 100 > F.col("positive") * 38).cast("int")
    score = F.round(F.try_divide(F.col("recommendations").cast("double"), F.col("positive")), 6)
    rows = cleaned(spark, sf).withColumns({"is_suspicious": flag, "anomaly_score": score})
    return labels.make_labels(rows, SCREEN)


@query("labels_without_flagged", "F1 A10", "WITH " + _FLAGGED + """
SELECT count(*) AS rows, round(avg(target_hit), 6) + 0.0 AS hit_rate,
  round(avg(CASE WHEN target_hidden_gem = 1 AND is_suspicious = 0 THEN 1 ELSE 0 END), 6) + 0.0 AS gem_rate,
  count(*) FILTER (target_hidden_gem = 1 AND is_suspicious = 1) AS gems_excluded FROM flagged""")
def labels_without_flagged(spark, sf):
    return labels.label_summary(_flagged(spark, sf), SCREEN).withColumns({"hit_rate": r6("hit_rate"), "gem_rate": r6("gem_rate")})


@query("flagged_rows", "T3", "WITH " + _FLAGGED + """
SELECT appid, name, total_reviews_calc, round(positive_ratio, 6) + 0.0 AS positive_ratio, anomaly_score + 0.0 AS anomaly_score, price
FROM flagged WHERE is_suspicious = 1 ORDER BY flagged.anomaly_score DESC, appid LIMIT 20""")
def flagged_rows(spark, sf):
    top = reports.suspicious(_flagged(spark, sf), 20)
    return top.select("appid", "name", "total_reviews_calc", r6("positive_ratio").alias("positive_ratio"), r6("anomaly_score").alias("anomaly_score"), "price")


def _vector_points(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


_NEIGHBOURS = """
SELECT id, neighbour, round(d, 6) + 0.0 AS distance, rank FROM (
  SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS INT) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5"""


@query("nearest_neighbours", "J8", _NEIGHBOURS)
def nearest_neighbours(spark, sf):
    return neighbours.k_nearest(_vector_points(spark, sf), 5).withColumn("distance", r6("distance"))


@query("nearest_neighbours_by_cells", "J8", _NEIGHBOURS)
def nearest_neighbours_by_cells(spark, sf):
    """The route for tables too large to broadcast."""
    return neighbours.k_nearest(_vector_points(spark, sf), 5, block=60, pivots=16).withColumn("distance", r6("distance"))


_DRAW = "CAST(CAST(('0x' || substr(md5(concat(appid, '|', copy, '|42{s}')), 1, 12)) AS BIGINT) AS DOUBLE) / pow(16.0, 12)"


@query("oversampled", "F17 J8", "WITH " + LABELLED + f""",
r AS (SELECT appid, target_hidden_gem AS y, price, required_age, ln(1 + price) AS log_price FROM labelled),
m AS (SELECT *, row_number() OVER (ORDER BY md5(concat(appid, '|42'))) AS rk FROM r WHERE y = 1),
size AS (SELECT count(*) FILTER (y = 1) AS have, count(*) FILTER (y = 0) - count(*) FILTER (y = 1) AS need FROM r),
nn AS (SELECT * FROM (SELECT a.appid, b.appid AS neighbour, b.price AS p2, b.required_age AS a2, b.log_price AS l2,
    row_number() OVER (PARTITION BY a.appid ORDER BY round(sqrt(pow(a.price - b.price, 2) + pow(a.required_age - b.required_age, 2) + pow(a.log_price - b.log_price, 2)), 9), b.appid) AS k
  FROM m a JOIN m b ON a.appid <> b.appid) WHERE k <= 5),
seeds AS (SELECT m.*, unnest(range(1, CAST(need // have + CASE WHEN rk <= need % have THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM m, size),
drawn AS (SELECT *, CAST(floor({_DRAW.format(s='n')} * 5) AS BIGINT) + 1 AS k, {_DRAW.format(s='g')} AS gap FROM seeds)
SELECT appid, y AS target_hidden_gem, round(price, 6) + 0.0 AS price, round(required_age, 6) + 0.0 AS required_age,
  round(log_price, 6) + 0.0 AS log_price, CAST(NULL AS BIGINT) AS neighbour, CAST(NULL AS DOUBLE) AS gap FROM r
UNION ALL SELECT d.appid, 1, round(price + gap * (p2 - price), 6) + 0.0, round(required_age + gap * (a2 - required_age), 6) + 0.0,
  round(log_price + gap * (l2 - log_price), 6) + 0.0, neighbour, round(gap, 6) + 0.0 FROM drawn d JOIN nn ON nn.appid = d.appid AND nn.k = d.k""")
def oversampled(spark, sf):
    rows = labelled(spark, sf).select("appid", "target_hidden_gem", "price", "required_age", F.log1p("price").alias("log_price"))
    columns = ["price", "required_age", "log_price"]
    made = smote.smote(checkpointed(rows), "target_hidden_gem", "appid", columns)
    return made.withColumns({c: r6(c) for c in (*columns, "gap")})
