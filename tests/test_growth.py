"""Work that must stay bounded or whole as tables grow."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_queries import registry, shaping
from catalog_queries.base import games, labelled
from shelfscope.operators import models, neighbours, reports, search, tfidf


def test_density_counts_every_value(spark):
    """the kernel of each value itself, not of shares in the cells beside it."""
    rows = spark.range(400).select((F.log1p(F.col("id")) * 7).alias("v"))
    v = np.array([r["v"] for r in rows.collect()])
    width = v.std(ddof=1) * len(v) ** -0.2
    height = (v.max() - v.min()) / 30 / (width * np.sqrt(2 * np.pi))
    for _, x, y in reports.density(rows, "v", 30, 20).collect():
        assert y == pytest.approx((np.exp(-0.5 * ((x - v) / width) ** 2) * height).sum(), rel=1e-9)


def test_queries_of_the_documents_own_table_in_blocks(spark):
    """a cogroup of two tables that share a column."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "doc_id long, v array<double>").select(
        "doc_id", F.col("v").alias("vector"))
    queries = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    want = sorted(map(tuple, search.vector_top(docs, queries, 4).collect()))
    assert sorted(map(tuple, search.vector_top(docs, queries, 4, block=5, point_block=20).collect())) == want and len(want) == 48


def test_blocks_of_neighbours_do_not_multiply(spark):
    """F1, F8: a row moves once for each of a few blocks, whatever the size of the table and of a broadcast one."""
    for sizes in ([6250] * 16, [390] * 256, [90_000, 10, 10, 9_980]):
        first, parts, blocks = neighbours._laid(sizes, max(60, min(-(-sum(sizes) // neighbours.SHARES), neighbours.MOST)))
        assert blocks <= 2 * neighbours.SHARES + 1 and max(f + p for f, p in zip(first, parts)) == blocks


@pytest.mark.parametrize("far", [0.0, 1e4])
def test_nearest_measures_what_single_precision_leaves_open(far, monkeypatch):
    monkeypatch.setattr(neighbours, "COLUMNS", 64)
    rng = np.random.default_rng(3)
    b = np.round(rng.normal(size=(300, 5)), 1) + far * (np.arange(300) % 2)[:, None]
    ids = rng.permutation(300)
    i, j, d = neighbours._nearest(ids, b, ids, b, 4)
    got = sorted(zip(ids[i].tolist(), d.tolist(), ids[j].tolist()))
    exact = np.round(np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)), 9)
    want = sorted((int(ids[r]), float(x), int(o)) for r in range(300)
                  for x, o in sorted((x, o) for x, o in zip(exact[r], ids) if o != ids[r])[:4])
    assert got == want


def test_texts_are_unfolded_in_bounded_parts(monkeypatch):
    """a batch of many long lists is met in parts."""
    monkeypatch.setattr(tfidf, "ITEMS", 10)
    lists = [["a"] * n for n in (3, 4, 5, 0, 25, 1, 9)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["_words"])
    parts = list(tfidf.unfolded([batch, batch.slice(0, 0)], "_words"))
    assert [x for p in parts for x in p["_words"].to_pylist()] == lists
    assert all(p.num_rows == 1 or len(p["_words"].flatten()) <= 10 for p in parts)


def test_dealt_tasks_grow_with_the_table(spark, sf, monkeypatch):
    """two tasks do not read a catalog of any size."""
    seen = []
    keep = shaping.clean.clean
    monkeypatch.setattr(shaping.clean, "clean", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or keep(df, *a))
    want = registry()["tied_copies"].run(spark, sf).first()
    assert seen == [2, 13]
    monkeypatch.setattr(shaping, "DEALT_PARTS", 100)
    assert registry()["tied_copies"].run(spark, sf).first() == want and seen[2:] == [4, 26]


def test_scores_by_table_read_stored_rows(spark, sf):
    """the catalog's joins run once, not for every tree."""
    from catalog_queries import modelling

    rows, _ = modelling._paired_trees(spark, sf)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "FileScan parquet" in text


def test_fits_take_as_many_tasks_as_pay(spark):
    """F2 to F5: rows, not upstream splits, say how many tasks a fit has."""
    rows = spark.range(5000).repartition(3)
    assert [models.dealt(rows, n).rdd.getNumPartitions() for n in (20_000, 1000, 1)] == [1, 5, 8]


def test_repeated_products_keep_the_whole_order(spark, sf, tmp_path):
    """Only a table without repeated keys may be cut by the stated order alone."""
    for t in ("part", "lineitem", "documents"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df.unionByName(df.withColumn("text", F.lit("other"))) if t == "documents" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    text = labelled(spark, str(tmp_path)).select("appid", "wilson_lb")._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" in text and games(spark, str(tmp_path)).count() > games(spark, sf).count()


def test_ngrams_are_counted_as_numbers(spark, monkeypatch):
    """no row per n-gram of the corpus; nulls, empty lists and repeated rows count as they did."""
    from collections import Counter

    lists = [["b", "a", "b", "a"], ["a"], [], None, ["a", None, "b"], ["b", "a", "b", "a"]]
    words = spark.createDataFrame([(ws,) for ws in lists], "_words array<string>")
    plans, keep = [], tfidf.stored
    monkeypatch.setattr(tfidf, "stored", lambda df, kind: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, kind))
    got = {r["term"]: r["n"] for r in tfidf.most_used(words, 3, 100, 16).collect()}
    assert plans and all("Generate" not in p for p in plans)
    want = Counter(" ".join(ws[k:k + n]) for ws in lists if ws for n in (1, 2, 3) for k in range(len(ws) - n + 1) if None not in ws[k:k + n])
    assert got == want
    assert tfidf.most_used(words.limit(0), 2, 5, 16).count() == 0


def test_grid_forests_are_grown_in_parts(spark, monkeypatch):
    """a fold's trees are grown by several fits of few tasks, each with a seed of its own, and stay one forest."""
    fits, keep = [], models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **kw: fits.append((kw["numTrees"], kw["seed"])) or keep(**kw))
    monkeypatch.setattr(models, "GRID_TREES", 2, raising=False)
    rows = spark.range(60).selectExpr("id appid", "cast(id % 3 = 0 as int) target", "cast(id % 3 as double) x", "cast(id % 7 as double) y")
    votes, seconds = models.grid_votes(rows, "target", "appid", ["x", "y"], [2], [1, 5], folds=2)
    assert sorted(n for n, _ in fits) == [1, 1, 2, 2, 2, 2] and len({s for _, s in fits}) == 6
    assert votes.count() == 60 and seconds.count() == 4
    scores = {r["n_estimators"]: r["mean_test_score"] for r in models.grid_scores(votes, seconds, "target", [2], [1, 5]).collect()}
    assert scores[5] == 1.0


def test_forests_keep_the_nodes_of_their_rows(spark):
    """a level of a forest does not walk all trees from their roots; the forest itself is the same."""
    rows = models.assembled(spark.range(400).selectExpr(
        "cast(hash(id) % 3 = 0 as double) label", "1D + id % 2 weight", "id % 7 x", "hash(id, 1) % 11 y", "id % 13 z"), ["x", "y", "z"]).coalesce(2).persist()
    estimator = models.forest(3, models.Effort(trees=12, forest_depth=6), 3)
    assert estimator.getCacheNodeIds()
    made, plain = estimator.fit(rows), estimator.copy({estimator.cacheNodeIds: False}).fit(rows)
    rows.unpersist()
    assert made.totalNumNodes > 12 and [t.toDebugString.split("\n", 1)[1] for t in made.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]


def _held(x, y, w, held=None):
    from shelfscope.operators import forests

    n = len(y)
    part = (x.astype("uint8").tobytes(), (np.zeros(n, bool) if held is None else held).tobytes(), y.astype("uint8").tobytes(),
            w.astype(float).tobytes(), np.arange(n, dtype=np.int64).tobytes())
    return forests.Rows({(0, 0): part}, x.shape[1])


@pytest.mark.parametrize("by_class", [True, False])
def test_trees_grown_in_a_task_are_those_by_hand(by_class, monkeypatch):
    """F1, F4 to F7: every node against a search over all its rows, columns and bins; then leaves that say the same are merged."""
    from shelfscope.operators import forests

    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 6, (300, 4)), draw.random(300) < 0.3
    y = (y | (x[:, 1] > 3) & (x[:, 2] < 2)).astype(int)
    w = np.where(y == 1, 1.7, 0.6) if by_class else draw.random(300) + 0.5
    held = draw.random(300) < 0.1
    rows_, rng = _held(x, y, w, held), lambda: np.random.Generator(np.random.SFC64([1, 2]))
    merged = forests.grown(rows_, np.full(4, 6), 7, 4, rng())
    monkeypatch.setattr(forests, "_pruned", lambda tree, where: tree)
    tree = forests.grown(rows_, np.full(4, 6), 7, 4, rng())
    times = rng().poisson(1.0, 300) * ~held

    def gain(rows, c, k):
        low, score = x[rows, c] <= k, 0.0
        if not 0 < low.sum() < len(rows):
            return 0.0
        for side in (rows[low], rows[~low]):
            m = times[side] * w[side]
            score += (m * y[side]).sum() ** 2 / m.sum()
        m = times[rows] * w[rows]
        return 2 * (score - (m * y[rows]).sum() ** 2 / m.sum()) / m.sum()

    def walk(k, rows, depth):
        mass = [(times[rows] * w[rows])[y[rows] == c].sum() for c in (0, 1)]
        assert [tree["zeros"][k], tree["ones"][k]] == pytest.approx(mass) and tree["raw"][k] == times[rows].sum() and tree["level"][k] == depth
        best = max(gain(rows, c, j) for c in range(4) for j in range(5)) if depth < 7 and min(mass) > 0 else 0.0
        if best < 1e-9:
            assert tree["feature"][k] == tree["left"][k] == tree["right"][k] == -1
            return 1
        c, j = tree["feature"][k], tree["cut"][k]
        assert tree["gain"][k] == pytest.approx(best) == pytest.approx(gain(rows, c, j))
        low = x[rows, c] <= j
        return 1 + walk(tree["left"][k], rows[low], depth + 1) + walk(tree["right"][k], rows[~low], depth + 1)

    assert walk(0, np.flatnonzero(times), 0) == len(tree["raw"]) > 60

    def says(tree, row):
        k = 0
        while tree["feature"][k] >= 0:
            k = tree["left" if row[tree["feature"][k]] <= tree["cut"][k] else "right"][k]
        return tree["ones"][k] > tree["zeros"][k]

    assert [says(tree, r) for r in x] == [says(merged, r) for r in x] and len(merged["raw"]) < len(tree["raw"])
    for a, b in zip(merged["left"], merged["right"]):
        assert a < 0 or max(merged["feature"][[a, b]]) >= 0 or (merged["ones"] > merged["zeros"])[a] != (merged["ones"] > merged["zeros"])[b]


def _classed(spark, n=3000):
    return spark.range(n).selectExpr("id", "cast(hash(id) % 1000 as double) x0", "cast(hash(id, 1) % 7 as double) x1", "cast(id % 2 as double) x2",
                                     "cast(hash(id, 2) % 90 as double) x3").selectExpr(
        "*", "cast(x0 / 500 + x1 / 7 + hash(id, 3) % 100 / 200 > 0.6 as double) y")


def test_large_forests_are_grown_in_tasks(spark, monkeypatch):
    """F4 to F7: above a number of rows no forest is fitted level by level; the model is Spark's, and as good as Spark's."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from shelfscope.operators import forests, model_tables

    columns = ["x0", "x1", "x2", "x3"]
    rows = _classed(spark).persist()
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    experiment = next(e for e in models.EXPERIMENTS if e.name == "forest_balanced")
    effort = models.Effort(trees=30, forest_depth=6)
    by_spark = models.fit(experiment, train, "y", columns, effort, 3)
    monkeypatch.setattr(models, "FOREST_ROWS", 100)
    fits, keep = [], forests.RandomForestClassifier.fit
    monkeypatch.setattr(forests.RandomForestClassifier, "fit", lambda self, df, *a: fits.append((self.getMaxDepth(), df.count())) or keep(self, df, *a))
    made = [models.fit(experiment, train, "y", columns, effort, 3) for _ in range(2)]
    assert fits == [(0, 2)] * 2  # two rows, for the form of the model
    assert type(made[0]) is type(by_spark) and made[0].getNumTrees == 30 and made[0].getMaxDepth() == 6 and made[0].numFeatures == 4
    assert made[0].toDebugString.split("\n", 1)[1] == made[1].toDebugString.split("\n", 1)[1]
    assert max(t.depth for t in made[0].trees) == 6 and len({t.toDebugString.split("\n", 1)[1] for t in made[0].trees}) == 30
    areas = [BinaryClassificationEvaluator(labelCol="y").evaluate(m.transform(models.assembled(test, columns))) for m in (made[0], by_spark)]
    assert areas[0] == pytest.approx(areas[1], abs=0.02) and areas[0] > 0.8
    assert made[0].featureImportances.toArray() == pytest.approx(by_spark.featureImportances.toArray(), abs=0.05)
    want = {r["id"]: r["score"] for r in models.scores(made[0], test, columns).collect()}
    table = model_tables.model_table(made[0], spark)
    assert {r["id"]: r["s"] for r in model_tables.table_scores(test, columns, table, "forest", "s").collect()} == pytest.approx(want)
    monkeypatch.setattr(forests, "HELD_CELLS", 10)  # more than a task may hold: Spark's fit, the same model as below the limit
    assert models.fit(experiment, train, "y", columns, effort, 3).toDebugString.split("\n", 1)[1] == by_spark.toDebugString.split("\n", 1)[1]
    rows.unpersist()


def test_bins_of_columns_are_those_of_all_rows(spark, monkeypatch):
    """Few values: cut between all of them; many: near equal shares of the weight, for each set without its own fold."""
    from shelfscope.operators import forests

    rows = models.assembled(spark.range(4000).selectExpr("cast(id % 3 as double) a", "cast(id as double) b", "cast(null as double) c",
                                                         "1D label", "cast(id >= 2000 as int) fold"), ["a", "b", "c"])
    cuts, n, labels = forests.summary(forests.ready_rows(rows.repartition(3), "fold"), 3, 2, 32)
    assert n == 4000 and 1.0 in labels and len(labels) > 1  # the missing column
    for s, first in ((0, 2000), (1, 0)):
        assert list(cuts[s][0]) == [0.5, 1.5] and len(cuts[s][2]) == 0
        assert list(cuts[s][1]) == pytest.approx([first + 2000 * k / 32 for k in range(1, 32)], abs=2)
    monkeypatch.setattr(forests, "VALUES", 500)
    values, counts = forests._thinned(np.arange(4000.0), np.ones((4000, 1)))
    assert len(values) == 500 and counts.sum() == 4000 and list(np.cumsum(counts)) == pytest.approx(values + 1)


def test_grid_is_grown_and_judged_in_tasks(spark, monkeypatch):
    """no fit of Spark, no tree on the driver; votes against trees grown one by one, and like those of Spark's fits."""
    from shelfscope.operators import forests

    columns, rows = ["x0", "x1", "x2", "x3"], _classed(spark, 1500).persist()
    ask = lambda: models.grid_votes(rows, "y", "id", columns, [2, 6], [3, 8], folds=3)
    recall = lambda votes, seconds: {(r["max_depth"], r["n_estimators"]): r["mean_test_score"] for r in models.grid_scores(
        votes, seconds, "y", [2, 6], [3, 8]).collect()}
    monkeypatch.setattr(models, "GRID_TREES", 5)
    monkeypatch.setattr(forests, "HELD_CELLS", 10)
    by_spark = recall(*ask())
    monkeypatch.undo()
    monkeypatch.setattr(models, "GRID_TREES", 5)
    monkeypatch.setattr(forests.RandomForestClassifier, "fit", lambda *a: pytest.fail("a fit of Spark"))
    votes, seconds = ask()
    assert recall(votes, seconds) == pytest.approx(by_spark, abs=0.12)
    assert sorted(r["id"] for r in votes.collect()) == list(range(1500)) and seconds.count() == 12
    times = {(r["fold"], r["point"]): r["seconds"] for r in seconds.collect()}
    assert all(0 < times[f, 0] < times[f, 1] < times[f, 3] and times[f, 0] <= times[f, 2] < times[f, 3] for f in range(3))
    # the same rows through the parts one by one
    data = models.assembled(rows.join(votes.select("id", "fold"), "id"), columns, "y").select("features", "label", "fold", F.col("id").alias("row")).orderBy("row").coalesce(1)
    kept = forests.ready_rows(data, "fold", "row")
    cuts, _, _ = forests.summary(kept, 4, 3, 32)
    blocks = [b for b in forests.blocks(kept, 4, cuts).collect() if b["set"] == 1]
    held = forests.Rows({(b["part"], b["block"]): tuple(map(bytes, (b["x"], b["held"], b["y"], b["w"], b["row"]))) for b in blocks}, 4)
    assert held.held.sum() == votes.where("fold = 1").count() and list(held.row) == list(range(1500))
    for c, at in enumerate(cuts[1]):
        x = np.array([r["features"][c] for r in data.collect()])
        assert list(held.x[:, c] // 2) == [int((at < v).sum()) for v in x] and list(held.x[:, c] % 2) == list(held.y)
    rows.unpersist()


def test_large_perceptrons_take_the_steps_of_spark_s(spark, monkeypatch):
    """F2: the same weights in double precision, smaller last blocks included, and nearly the same in single; no fit of Spark over the rows."""
    from shelfscope.operators import perceptrons

    columns = ["x0", "x1", "x2", "x3"]
    train = _classed(spark, 900).selectExpr("id", "y", "x0 / 500 x0", "x1 / 7 x1", "x2", "x3 / 90 x3").persist()
    experiment = next(e for e in models.EXPERIMENTS if e.name == "perceptron_raw")
    monkeypatch.setattr(models, "LEAST_ROWS", {"perceptron": 300})  # three tasks, none of whole blocks of 128 rows
    effort = models.Effort(mlp_iterations=12)
    by_spark = models.fit(experiment, train, "y", columns, effort, 3)
    fits, keep = [], perceptrons.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(models, "PERCEPTRON_ROWS", 100)
    monkeypatch.setattr(perceptrons.MultilayerPerceptronClassifier, "fit",
                        lambda self, df, *a: fits.append((self.getMaxIter(), df.count())) or keep(self, df, *a))
    single = models.fit(experiment, train, "y", columns, effort, 3)
    monkeypatch.setattr(perceptrons, "KIND", np.float64)
    monkeypatch.setattr(perceptrons, "PACKED", 256)
    monkeypatch.setattr(perceptrons, "ROWS", 100)
    double = models.fit(experiment, train, "y", columns, effort, 3)
    assert fits == [(0, 2)] * 4  # the first weights, and the form of the model
    want = by_spark.weights.toArray()
    assert type(double) is type(by_spark) and double.getLayers() == [4, 128, 64, 2]
    assert double.weights.toArray() == pytest.approx(want, abs=1e-8)
    at = {r["id"]: r["score"] for r in models.scores(by_spark, train, columns).collect()}
    assert {r["id"]: r["score"] for r in models.scores(single, train, columns).collect()} == pytest.approx(at, abs=1e-2)
    with pytest.raises(Exception, match="without missing features"):
        models.fit(experiment, train.withColumn("x1", F.when(F.col("id") > 5, F.col("x1"))), "y", columns, effort, 3)
    train.unpersist()


def test_lbfgs_reaches_the_least_value():
    """A curved valley, and a value whose search fails: twice by the gradient alone ends it where it stands."""
    from shelfscope.operators import perceptrons

    def valley(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array(
            [-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    assert perceptrons.lbfgs(valley, np.array([-1.2, 1.0]), 200, 1e-12) == pytest.approx([1, 1], abs=1e-4)
    start = np.array([3.0, -2.0])
    assert list(perceptrons.lbfgs(valley, start, 0, 1e-6)) == list(start)
    assert list(perceptrons.lbfgs(lambda x: (float(x @ x), -2 * x), start, 50, 1e-6)) == list(start)  # a slope of the wrong sign
