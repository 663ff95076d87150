"""Operators against brute force, invariants and literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_queries.base import CFG, cleaned, labelled, table
from shelfscope.config import CatalogConfig
from shelfscope.operators import (
    anomaly, clean, features, gate, labels, metrics, models, neighbours, quality, reports, retrieval_eval, search, skew,
    smote, split, tfidf)
from shelfscope.sources.normalise import normalise_schema


# --- skew-safe helpers -----------------------------------------------------

@pytest.mark.parametrize("rows_limit", [500_000, 3])
def test_lookup_is_whole_on_both_routes(spark, monkeypatch, rows_limit):
    monkeypatch.setattr(skew, "LOOKUP_ROWS", rows_limit)
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    keys = ["unknown"] * 50 + [f"k{i % 7}" for i in range(40)] + ["solo"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    counts = rows.groupBy(F.col("key").alias("item")).agg(F.count("*").alias("n"))
    got = skew.add_lookup(rows, counts, "key", "id", "n").collect()
    assert len(got) == len(keys)
    assert all(r["n"] == keys.count(r["key"]) for r in got)


def test_running_totals(spark):
    rng = random.Random(1)
    data = [(g, s / 1000, rng.randint(0, 5)) for g in ("a", "b") for s in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(data, "g string, s double, n long")
    for r in skew.running_totals(df, "s", ["n"], ["g"]).collect():
        assert r["cum_n"] == sum(n for g, s, n in data if g == r["g"] and s >= r["s"])
        assert r["all_n"] == sum(n for g, _, n in data if g == r["g"])


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], list(range(1000)), [5.0] * 300 + [7.0], [random.Random(3).gauss(0, 1) for _ in range(777)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.001, 0.5, 0.98, 0.999, 1.0]
    assert skew.exact_quantiles(df, "v", shares, accuracy=50) == pytest.approx(list(np.quantile(values, shares)))


def test_exact_quantile_of_nothing(spark):
    assert skew.exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_draw_rank_equals_sorting(spark):
    df = spark.range(500).withColumns({"y": (F.col("id") % 3 == 0).cast("int"), "d": skew.draw_order("id", 42)})
    got = skew.draw_rank(df, "y", "d", "r", digits=1).collect()
    for label in (0, 1):
        rows = sorted((r["d"], r["r"]) for r in got if r["y"] == label)
        assert [r for _, r in rows] == list(range(1, len(rows) + 1))


# --- cleaning and labels ---------------------------------------------------

RAW = "appid long, name string, release_date string, price string, required_age string, positive long, negative long, estimated_owners string"


def test_cleaning_keeps_first_copy_and_counts_steps(spark):
    rows = [
        (1, "b", "2020-01-01", "150", "99", 40, None, "0 - 20000"), (1, "a", "soon", "1", "0", 40, 1, "0 - 20000"),
        (2, "c", "Oct 21, 2008", "free", "-3", None, 50, "20,000 - 50,000"), (3, "d", "bad", "1", "0", 50, 1, "0 - 20000"),
        (4, "e", "2025-03-01", "1", "0", 50, 1, "0 - 20000"), (5, "f", "2015-01-01", "1", "0", 2, 1, "0 - 20000"),
        (6, "g", "2024-09-11", "120", "18", 50, 50, "x"), (7, "h", "2024-09-12", "120", "18", 50, 50, "x")]
    df = spark.createDataFrame(rows, RAW)
    got = {r["appid"]: r for r in clean.clean(df, CatalogConfig(), ["name"]).collect()}
    assert set(got) == {2, 6}
    assert (got[2]["price"], got[2]["required_age"], got[2]["total_reviews_calc"]) == (0.0, 0.0, 50)
    assert (got[6]["price"], got[6]["required_age"]) == (100.0, 18.0)
    funnel = clean.cleaning_funnel(df, CatalogConfig(), ["name"]).first().asDict()
    assert funnel == {"rows_in": 8, "duplicates_removed": 1, "bad_dates_removed": 2, "too_recent_removed": 2,
                      "too_few_reviews_removed": 1, "prices_clipped": 1, "rows_out": 2, "kept_share": 0.25}


def test_density_of_distinct_values(spark):
    """Sharing rows between cells stays within the stated error of the kernel over all rows."""
    import numpy as np
    from pyspark.sql import functions as F

    from shelfscope.operators import reports

    rows = spark.range(5000).select((F.log1p(F.col("id")) + F.col("id") / 1000).alias("v"))
    v = np.array([r["v"] for r in rows.collect()])
    got = sorted(map(tuple, reports.density(rows, "v", 30, 50).collect()))
    width = v.std(ddof=1) * len(v) ** -0.2
    height = (v.max() - v.min()) / 30 / (width * np.sqrt(2 * np.pi))
    cell = (v.max() - v.min()) / (49 * reports.FINE)
    for _, x, y in got:
        assert abs(y - (np.exp(-0.5 * ((x - v) / width) ** 2) * height).sum()) <= len(v) * height * (cell / width) ** 2 / 8
    assert len(got) == 50 and reports.density(rows.limit(1), "v", 30).count() == 0


def test_tied_copies_give_one_result(spark):
    """Copies that tie in the stated order: the same row stays under every partitioning, and the funnel counts that row."""
    copies = [(1, "a", "2015-01-01", p, age, pos, None, own) for p in ("5", None, "200") for age in ("0", "18")
              for pos in (3, 40, None) for own in ("0 - 1", None)]
    seen = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(copies, RAW).repartition(parts)
        seen.add(tuple(map(repr, clean.clean(df, CatalogConfig().with_(min_total_reviews=0), ["name"]).collect())))
        seen.add(clean.cleaning_funnel(df, CatalogConfig(), ["name"]).first()["rows_out"])
    assert len(seen) == 2 and 0 in seen  # the copy without reviews comes first


def test_labels_drop_unreadable_owners_and_exclude_flagged(spark):
    df = spark.createDataFrame(
        [(1, 100, 100, "0 - 20000", 0), (2, 100, 100, "0 - 20000", 1), (3, None, 60, "100,000 - 200,000", 0), (4, 9, 10, "x", 0)],
        "appid long, positive long, total_reviews_calc long, estimated_owners string, is_suspicious int")
    made = labels.make_labels(df, CatalogConfig())
    got = {r["appid"]: r for r in made.collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["target_hidden_gem"], got[2]["target_hidden_gem"], got[3]["target_hit"]) == (1, 0, 1)
    assert got[3]["positive_ratio"] == 0.0 and got[3]["wilson_lb"] == pytest.approx(0.0, abs=1e-12)
    assert labels.label_summary(made, CatalogConfig()).first()["gems_excluded"] == 1


def test_schema_normaliser_fills_missing_columns(spark):
    df = spark.createDataFrame([("7.5", "x"), (None, "2019")], "price string, releaseyear string")
    assert normalise_schema(df, "drop").count() == 1
    rows = normalise_schema(df, "zero").orderBy("release_year").collect()
    assert [r["release_year"] for r in rows] == [0, 2019] and rows[0]["name"] == "Unknown Game"
    with pytest.raises(ValueError):
        normalise_schema(df, "keep")


# --- anomaly screen --------------------------------------------------------

def test_screen_flags_the_share_and_finds_a_planted_outlier(spark, sf):
    cfg = CFG.with_(anomaly_enabled=True, anomaly_trees=50, contamination=0.05)
    base = cleaned(spark, sf, cfg)
    odd = base.limit(1).withColumns({
        "appid": F.lit(-1).cast("long"), "positive": F.lit(10 ** 6).cast("long"), "recommendations": F.lit(10 ** 8).cast("long"),
        "total_reviews_calc": F.lit(10 ** 8).cast("long"), "price": F.lit(100.0)})
    rows = anomaly.screen(base.unionByName(odd), cfg).select("appid", "is_suspicious", "anomaly_score").collect()
    flagged = sum(r["is_suspicious"] for r in rows)
    assert abs(flagged - 0.05 * len(rows)) <= 2
    top = max(rows, key=lambda r: r["anomaly_score"])
    assert top["appid"] == -1 and top["is_suspicious"] == 1
    again = {r["appid"]: r["anomaly_score"] for r in anomaly.screen(base.unionByName(odd), cfg).collect()}
    assert all(again[r["appid"]] == r["anomaly_score"] for r in rows)


def test_trees_take_the_rows_that_their_md5_names(spark):
    import hashlib

    cfg = CFG.with_(anomaly_trees=30, anomaly_sample=16)
    columns = [F.round(F.sin(F.col("id") * (i + 1)) * 10, 6).alias(c) for i, c in enumerate(anomaly.SIGNALS)]
    signals = spark.range(2000).select(F.col("id").alias("appid"), *columns)
    forest = anomaly.IsolationForest.fit(signals, cfg)
    assert len(forest.trees) == 30 and (forest.sample_size, forest.limit) == (16, 4)
    rows = {r["appid"]: [r[c] for c in anomaly.SIGNALS] for r in signals.collect()}
    order = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    pool = sorted(rows, key=lambda k: order(k, cfg.seed))[:30 * 16]
    for tree, made in enumerate(forest.trees):
        own = sorted(pool, key=lambda k: order(k, tree, cfg.seed))[:16]
        for node, feature, threshold, depth in anomaly._grow(np.array([rows[k] for k in own]), cfg.seed, tree, 4):
            assert (made["feature"][node], made["threshold"][node], made["depth"][node]) == (feature, threshold, depth)


def test_screen_can_be_switched_off(spark, sf):
    row = anomaly.screen(cleaned(spark, sf), CFG).first()
    assert (row["is_suspicious"], row["anomaly_score"]) == (0, 0.0)


# --- features, splits ------------------------------------------------------

def test_colliding_safe_names_keep_the_less_frequent_item(spark):
    df = spark.createDataFrame([(1, "['A-B']"), (2, "['A-B']"), (3, "['A B']")], "appid long, genres string")
    got = features.multi_hot(df, "genres", "genre", 5).orderBy("appid").collect()
    assert [r["genre_a_b"] for r in got] == [0, 0, 1]


def test_vocabulary_can_come_from_other_rows(spark, sf):
    df = labelled(spark, sf)
    made = features.engineer(df, CFG, df.where("appid % 50 = 1"))
    assert made.count() == df.count() and [c for c in made.columns if c.startswith("tag_")]


def test_scaler_round_trip_and_constants(spark):
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    scaler = split.Scaler.fit(df, ["a", "b"])
    assert scaler.std["a"] == pytest.approx(1.1180339887) and scaler.std["b"] == 1.0
    assert split.Scaler.from_table(scaler.to_table(spark)) == scaler
    assert [r["b"] for r in scaler.transform(df).collect()] == [0.0] * 4


# --- neighbours and oversampling -------------------------------------------

def _brute(points, k):
    out = set()
    for i, v in points.items():
        near = sorted((round(float(np.linalg.norm(np.subtract(v, w))), 6), j) for j, w in points.items() if j != i)
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_neighbours_by_cells_are_exact_under_copies(spark, copies):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(120, 4)), 2)
    # one vector may hold a third of all rows
    data = {i: base[0 if i < copies else i].tolist() for i in range(len(base))}
    df = spark.createDataFrame(list(data.items()), "id long, vector array<double>")
    for block, pivots in ((1000, 8), (25, 6)):
        got = {(r["id"], r["neighbour"], r["rank"]) for r in neighbours.k_nearest(df, 3, block=block, pivots=pivots).collect()}
        assert got == _brute(data, 3)


def test_oversampling_balances_and_interpolates(spark, sf):
    columns = ["price", "required_age", "total_reviews_calc"]
    df = labelled(spark, sf).select("appid", "target_hit", *columns).persist()
    made = smote.smote(df, "target_hit", "appid", columns).collect()
    by_class = [sum(r["target_hit"] == c for r in made) for c in (0, 1)]
    assert by_class[0] == by_class[1]
    real = {r["appid"]: r for r in df.collect()}
    synthetic = [r for r in made if r["neighbour"] is not None]
    assert len(made) - len(synthetic) == len(real) and synthetic
    for r in synthetic:
        a, b = real[r["appid"]], real[r["neighbour"]]
        assert a["target_hit"] == b["target_hit"] == r["target_hit"] == 1
        for c in columns:
            low, high = sorted((a[c], b[c]))
            assert low - 1e-9 <= r[c] <= high + 1e-9
    per_parent = [sum(r["appid"] == k for r in synthetic) for k in {r["appid"] for r in synthetic}]
    assert max(per_parent) - min(per_parent) <= 1
    df.unpersist()


# --- search ----------------------------------------------------------------

def _index(spark):
    docs = spark.createDataFrame(
        [(1, "scary horror night"), (2, "scary horror night"), (3, "calm puzzle garden"), (4, "puzzle puzzle box")],
        "doc_id long, text string")
    return docs, tfidf.fit_text_index(docs, "doc_id", "text", 50)


def test_search_breaks_ties_by_id_and_rejects_unknown_methods(spark):
    _, index = _index(spark)
    queries = spark.createDataFrame([(1, "horror"), (2, "nothing here")], "query_id long, query string")
    got = search.search(queries, "ml", 5, index=index).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(1, 1, 1), (1, 2, 2)]
    with pytest.raises(ValueError):
        search.search(queries, "other", 5)


def test_keyword_routes_agree(spark, monkeypatch):
    _, index = _index(spark)
    queries = spark.createDataFrame([(1, "horror puzzle"), (2, "calm night"), (3, "box")], "query_id long, query string")
    first = sorted(tuple(r) for r in search.keyword_top(index, queries, 3).collect())
    assert first == sorted(tuple(r) for r in search.keyword_top(index, queries, 3, block=1, point_block=2).collect())
    monkeypatch.setattr(search, "PAIRS", 1)
    assert first == sorted(tuple(r) for r in search.keyword_top(index, queries, 3).collect())


def test_copies_of_a_key_are_hits_of_their_own(spark):
    rows = [(7, "scary horror night", 10), (7, "scary horror night", 90), (3, "calm puzzle garden", 5), (7, "horror", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, total_reviews long").coalesce(1)
    catalog = tfidf.with_row_id(docs.withColumns({"price": F.lit(1.0), "positive_ratio": F.lit(0.5)}))
    index = tfidf.fit_text_index(catalog, "doc_id", "text", 50)
    queries = spark.createDataFrame([(1, "scary horror night")], "query_id long, query string")
    hits = search.search(queries, "ml", 5, index=index).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["relevance"], 6)) for r in hits[:2]] == [(7, 1.0), (7, 1.0)] and len(hits) == 3
    for pool in (15, None):
        found = search.search_catalog(queries, catalog, "ml", 5, pool, index, popularity_weight=0.3).orderBy("rank").collect()
        assert [r["total_reviews"] for r in found] == [90, 10, 50] and {r["doc_id"] for r in found} == {7}
    strict = search.search_catalog(queries, catalog, "ml", 5, None, index, min_reviews=60).collect()
    assert [(r["total_reviews"], r["rank"]) for r in strict] == [(90, 1)]


def test_facets_first_by_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.6, 0.8], 50), (3, [0.0, 1.0], 500)], "doc_id long, vector array<double>, total_reviews long")
    catalog = docs.drop("vector").withColumn("positive_ratio", F.lit(1.0))
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    found = search.search_catalog(queries, catalog, "dl", 2, None, doc_vectors=docs.drop("total_reviews"), query_vectors=queries.drop("query"),
                                  min_reviews=20, popularity_weight=0.5).orderBy("rank").collect()
    # 0.5 * 0.6 / 0.6 + 0.5 * ln 51 / ln 501 and 0.5 * 0 + 0.5
    assert [r["doc_id"] for r in found] == [2, 3]
    assert found[0]["score"] == pytest.approx(0.5 + 0.5 * np.log(51) / np.log(501), abs=1e-6) and found[1]["score"] == pytest.approx(0.5, abs=1e-6)


def test_an_empty_vocabulary_gives_no_hits(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    index = tfidf.fit_text_index(docs, "doc_id", "text", 50)
    queries = spark.createDataFrame([(1, "horror")], "query_id long, query string")
    assert index.postings.count() == 0 and search.search(queries, "ml", 5, index=index).count() == 0


def test_relevance_blocks_agree(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b", None]), (3, None)], "doc_id long, tag_list array<string>")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["z"])], "query_id long, gold array<string>")
    want = [(1, 2), (2, 2)]
    assert sorted(map(tuple, retrieval_eval.relevant_counts(docs, queries).collect())) == want
    assert sorted(map(tuple, retrieval_eval.relevant_counts(docs, queries, block=1).collect())) == want


def test_routed_search_and_reranking(spark):
    docs, index = _index(spark)
    encoder = lambda texts: np.array([[t.count("a") + 1, t.count("o")] for t in texts], dtype=float)
    vectors = search.encode(docs, "doc_id", "text", encoder, batch=3)
    queries = spark.createDataFrame([(1, "puzzle"), (2, "무서운 게임"), (3, "a game to play at night alone")], "query_id long, query string")
    reasons = {r["query_id"]: (r["method"], r["reason"]) for r in search.route(queries).collect()}
    assert reasons == {1: ("ml", "short keywords"), 2: ("dl", "hangul text"), 3: ("dl", "natural language")}
    catalog = docs.withColumns({"total_reviews": F.col("doc_id") * 10, "price": F.lit(5.0), "positive_ratio": F.lit(0.5),
                                "windows": F.lit(True)})
    found = search.search_catalog(queries, catalog, "auto", 2, index=index, doc_vectors=vectors,
                                  query_vectors=search.encode(queries, "query_id", "query", encoder), min_reviews=20,
                                  platforms=["windows"], popularity_weight=0.3).collect()
    assert {r["query_id"] for r in found} == {1, 2, 3} and all(r["doc_id"] >= 2 for r in found)
    assert all(r["method"] == reasons[r["query_id"]][0] for r in found)


def test_retrieval_counts_nothing_relevant_as_zero(spark):
    docs = spark.createDataFrame([(1, ["a", "a"]), (2, ["b"])], "doc_id long, tag_list array<string>")
    queries = spark.createDataFrame([(1, ["a", "b"], "word"), (2, ["z"], "word")], "query_id long, gold array<string>, qtype string")
    hits = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "query_id long, doc_id long, rank int")
    got = {r["query_id"]: r for r in retrieval_eval.precision_recall(hits, docs, queries, 2).collect()}
    assert (got[1]["precision"], got[1]["recall"]) == (0.5, 0.5)
    assert (got[2]["precision"], got[2]["recall"], got[2]["relevant"]) == (0.0, 0.0, 0)


# --- metrics, gate, quality ------------------------------------------------

def test_binary_metrics_with_ties(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.4), (1, 0.4), (0, 0.1)]
    got = metrics.binary_metrics(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    # thresholds 0.9: p 1/2 r 1/3; 0.8: 2/3, 2/3; 0.4: 3/5, 1; 0.1: 1/2, 1
    assert got["pr_auc"] == pytest.approx(1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert got["roc_auc"] == pytest.approx((2.5 + 2 + 1.5) / 9)
    assert (got["best_threshold"], got["f1_at_best"]) == (0.4, pytest.approx(0.75))
    assert (got["precision"], got["recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_gate(spark):
    champions = spark.createDataFrame([("b", "old", 0.4, 3), ("c", "old", 0.4, 1), ("d", "old", 0.4, 2)], "task string, run_id string, value double, version int")
    runs = spark.createDataFrame([("a", "n", 0.1), ("b", "n", 0.4), ("c", "n", 0.5), ("e", "n", 0.3)], "task string, run_id string, pr_auc double")
    made = gate.gate(runs, champions, "pr_auc", 0.25)
    assert {r["task"]: (r["promoted"], r["version"]) for r in made.collect()} == {
        "a": (False, None), "b": (False, 3), "c": (True, 2), "e": (True, 1)}
    after = {r["task"]: (r["run_id"], r["version"]) for r in gate.new_champions(made, champions).collect()}
    assert after == {"b": ("old", 3), "c": ("n", 2), "d": ("old", 2), "e": ("n", 1)}


def test_quality_failure_raises(spark):
    meta = spark.createDataFrame([(10, 0.1, 0.1, 60, 17)], "rows long, hit_rate double, gem_rate double, features int, leakage_columns int")
    checks = quality.quality_checks(meta)
    assert {r["check"] for r in checks.where("NOT passed").collect()} == {"rows"}
    with pytest.raises(quality.QualityError, match="rows"):
        quality.require_quality(checks)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(2, None), (1, "y")], "i int, s string")
    first, second, third = [quality.fingerprint(d, ["i", "s"]).first()[0] for d in (a, b, c)]
    assert first == second != third and len(first) == 12


def test_histogram_keeps_empty_bins_and_the_maximum(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,), (None,)], "v double")
    assert [r["n"] for r in reports.histogram(df, "v", 4).orderBy("bin").collect()] == [2, 0, 0, 1]


# --- models ----------------------------------------------------------------

@pytest.fixture(scope="module")
def separable(spark, sf):
    """Whether a vector belongs to a low label, from its first coordinates."""
    columns = [f"x{i}" for i in range(8)]
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("appid"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    rows = rows.withColumn("target_hit", (F.col("x0") + F.col("x1") > 0.15).cast("int"))
    parts = split.stratified_split(rows, "target_hit", "appid").persist()
    return parts.where("split = 'train'"), parts.where("split = 'test'"), columns


def test_every_experiment_beats_the_base_rate(spark, separable):
    train, test, columns = separable
    effort = models.Effort(trees=10, rounds=5, mlp_iterations=30, forest_depth=5, boost_depth=3)
    runs, fitted = models.sweep(train, test, "target_hit", "appid", columns, effort=effort)
    rows = runs.collect()
    assert {r["name"] for r in rows} == {e.name for e in models.EXPERIMENTS} == set(fitted)
    for r in rows:
        assert r["pr_auc"] > 1.5 * r["positives"] / r["rows"], r["name"]
    assert [e.family for e in models.choose(models.EXPERIMENTS, ml_only=True)] == ["ML"] * 5
    top = models.importances(fitted["forest_balanced"], columns, spark, 2).collect()
    assert {r["feature"] for r in top} == {"x0", "x1"}


def test_perceptron_by_validation_and_products(spark, separable):
    train, test, columns = separable
    model, losses = models.perceptron_by_validation(train, test, "target_hit", columns, epochs=2, step=5, hidden=(8, 4))
    assert len(losses) == 2 and models.log_loss(models.scores(model, test, columns), "target_hit") == pytest.approx(min(losses))
    specs = spark.createDataFrame([(1, 0.0, 12, 2024, ["windows", "mac"], ["indie"])],
                                  "spec long, price double, release_month int, release_year int, platforms array<string>, genres array<string>")
    names = ["price", "is_free", "windows", "linux", "n_platforms", "genre_indie", "tag_x", "is_q4_release", "achievements"]
    row = models.product_features(specs, names).first()
    assert [row[c] for c in names] == [0.0, 1.0, 1.0, 0.0, 2.0, 1.0, 0.0, 1.0, 0.0]


def test_grid_search(spark, separable, tmp_path):
    """The points of one forest per fold; recall recomputed in SQL from the stored votes."""
    import duckdb

    train, _, columns = separable
    got = models.grid_search(train, "target_hit", "appid", columns, [1, 6], [3, 9], folds=2).collect()
    assert {(r["max_depth"], r["n_estimators"]) for r in got} == {(1, 3), (1, 9), (6, 3), (6, 9)}
    assert all(0 <= r["mean_test_score"] <= 1 and r["mean_fit_time"] > 0 for r in got)
    votes, seconds = models.grid_votes(train, "target_hit", "appid", columns, [1, 6], [3, 9], folds=2)
    assert votes.count() == train.count() and seconds.count() == 8
    votes.coalesce(1).write.parquet(str(tmp_path / "votes"))
    want = duckdb.sql(f"""
        SELECT k, avg(r) FROM (SELECT fold, k, count(*) FILTER (target_hit = 1 AND votes[k + 1]) / count(*) FILTER (target_hit = 1) AS r
          FROM read_parquet('{tmp_path}/votes/*.parquet'), range(4) t(k) GROUP BY fold, k) GROUP BY k ORDER BY k""").fetchall()
    scores = {(r["max_depth"], r["n_estimators"]): r["mean_test_score"]
              for r in models.grid_scores(votes, seconds, "target_hit", [1, 6], [3, 9]).collect()}
    assert [scores[p] for p in ((1, 3), (1, 9), (6, 3), (6, 9))] == pytest.approx([v for _, v in want])
    assert scores[6, 9] > 0.5


def test_inverted_index_gives_the_scan_s_answer(spark, tmp_path):
    """Equal hits under any block size, few blocks scored where documents have topics, and only the queried buckets read."""
    import random

    from shelfscope.operators import inverted_index as inv

    rng = random.Random(2)
    topic = lambda t: " ".join(f"t{t}x{int(rng.paretovariate(0.8)) % 40}" for _ in range(30))
    texts = [topic(k % 30) + " common" * (k % 3) for k in range(1500)] + ["t1x1 t1x1", "t1x1 t1x1", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(k, f"t{k}x1 t{k}x{1 + k % 3} t{k}x{2 + k % 5}") for k in range(20)] + [(20, "t1x1 t2x1 common"), (21, "unheard of"), (22, None)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = tfidf.fit_text_index(docs, "doc_id", "text", 5000, 2)
    fields = ["query_id", "doc_id", "row_id", "relevance", "rank"]
    want = sorted(map(tuple, search.search(queries, "ml", 7, index=index).select(fields).collect()))
    for block, first in ((16, 2), (1000, 8)):
        stored_ = inv.write_inverted_index(index, str(tmp_path / f"b{block}"), 16, block)
        assert sorted(map(tuple, inv.indexed_top(stored_, queries, 7, first=first).select(fields).collect())) == want
    stored_ = inv.read_inverted_index(spark, str(tmp_path / "b16"), buckets=16)
    assert inv.scored_share(stored_, queries, 7, first=2) < 0.5
    one = inv._Batch(stored_, queries.where("query_id = 3"), "query")
    plan = one.bounds()._jdf.queryExecution().executedPlan().toString()
    read = one.postings.select("bucket").distinct().count()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [bucket" in plan
    assert read < 16 and "docs" not in plan.split("ReadSchema")[1].split("\n")[0]
    none = inv.write_inverted_index(tfidf.fit_text_index(docs.limit(0), "doc_id", "text", 50), str(tmp_path / "none"))
    assert inv.indexed_top(none, queries, 3).count() == 0


def test_most_used_terms_through_the_sketch(spark):
    """The sketch gives the terms of a full count, also where its buckets are few and shared; n-grams of three words."""
    import random
    from collections import Counter

    from shelfscope.functions.text import STOP_WORDS
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    texts = [" ".join(words[k:k + 60]) for k in range(0, 6000, 60)] + ["", None, "w1", "w1 w1 w1 w1", "the of and"]
    lists = [[w for w in (t or "").split() if w not in STOP_WORDS] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    uses, held = Counter(), Counter()
    for ws in lists:
        grams = [" ".join(ws[k:k + n]) for n in (1, 2, 3) for k in range(len(ws) - n + 1)]
        uses.update(grams)
        held.update(set(grams))
    for terms, buckets in ((40, 1 << 20), (40, 64), (10**6, 1 << 20)):
        got = tfidf.fit_vocabulary(docs.select(F.split(F.coalesce("text", F.lit("")), " ").alias("_words")).select(
            F.filter("_words", lambda w: (w != "") & ~w.isin(*STOP_WORDS)).alias("_words")), 3, terms, buckets)
        want = sorted(uses.items(), key=lambda x: (-x[1], x[0]))[:terms]
        assert [(r["term"], r["cf"]) for r in got.orderBy("at").collect()] == want
        assert all(r["df"] == held[r["term"]] for r in got.collect())
    index = tfidf.fit_text_index(docs, "doc_id", "text", 40, 3)
    idf = {r["term"]: r["idf"] for r in index.vocabulary.collect()}
    for r in index.documents.collect():
        ws = lists[r["doc_id"]]
        tf = Counter(g for n in (1, 2, 3) for g in (" ".join(ws[k:k + n]) for k in range(len(ws) - n + 1)) if g in idf)
        length = sum((n * idf[g]) ** 2 for g, n in tf.items()) ** 0.5
        names = {k["at"]: k["term"] for k in index.vocabulary.collect()} if r["doc_id"] == 0 else names
        assert {names[a]: w for a, w in zip(r["indices"], r["weights"])} == pytest.approx({g: n * idf[g] / length for g, n in tf.items()})
    none = tfidf.fit_text_index(docs.limit(0), "doc_id", "text", 40)
    assert none.vocabulary.count() == none.documents.count() == 0


def walk(nodes, row, depth=99):
    """Value of a row in one tree, node by node."""
    at = 0
    while nodes[at]["feature"] is not None and depth:
        at, depth = nodes[at]["left"] if row[nodes[at]["feature"]] <= nodes[at]["threshold"] else nodes[at]["right"], depth - 1
    return nodes[at]["value"]


def test_model_tables_score_like_their_models(spark, separable, tmp_path):
    """Tables of fitted models against the models, against DuckDB on the same rows, and cut against a walk by hand."""
    import duckdb
    from pyspark.sql import functions as F

    from shelfscope.operators import model_tables as mt

    train, test, columns = separable
    effort = models.Effort(trees=7, rounds=4, forest_depth=5, boost_depth=3)
    rows = test.select("appid", *columns).orderBy("appid").limit(200).cache()
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    for name in ("logistic_balanced", "forest_balanced", "boosted_weighted"):
        model = models.fit(next(e for e in models.EXPERIMENTS if e.name == name), train, "target_hit", columns, effort, 1)
        table, kind = mt.model_table(model, spark), mt.kind_of(model)
        want = {r["appid"]: r["score"] for r in models.scores(model, rows, columns).collect()}
        for nodes in (None, 40):  # in one block, and in several
            got = {r["appid"]: r["score"] for r in mt.table_scores(rows, columns, table, kind, nodes=nodes).collect()}
            assert got == pytest.approx(want, abs=1e-9), name
        table.coalesce(1).write.parquet(str(tmp_path / name))
        path, data = f"read_parquet('{tmp_path}/{name}/*.parquet')", f"read_parquet('{tmp_path}/rows/*.parquet')"
        values = f"(SELECT *, [{', '.join(columns)}] AS x FROM {data})"
        if kind == "linear":
            sql = f"SELECT appid, 1 / (1 + exp(-sum(coefficient * CASE WHEN feature < 0 THEN 1 ELSE x[feature + 1] END))) FROM {values}, {path} GROUP BY appid"
        else:
            end = "sum(value) / count(*)" if kind == "forest" else "1 / (1 + exp(-2 * sum(weight * value)))"
            sql = f"""WITH RECURSIVE m AS (FROM {path}), went(appid, x, tree, node) AS (
                SELECT appid, x, tree, 0 FROM {values}, (SELECT DISTINCT tree FROM m)
                UNION ALL SELECT appid, x, tree, CASE WHEN x[feature + 1] <= threshold THEN "left" ELSE "right" END
                FROM went JOIN m USING (tree, node) WHERE feature IS NOT NULL)
                SELECT appid, {end} FROM went JOIN m USING (tree, node) WHERE feature IS NULL GROUP BY appid"""
        assert dict(duckdb.sql(sql).fetchall()) == pytest.approx(want, abs=1e-9), name
        if kind == "forest":
            importances = dict(zip(columns, model.featureImportances.toArray()))
            assert {r["feature"]: r["importance"] for r in mt.table_importances(table, columns).collect()} == pytest.approx(importances)
            trees = {}
            for r in table.collect():
                trees.setdefault(r["tree"], {})[r["node"]] = r
            forest = mt.Trees(table.toArrow())
            votes = mt.cut_votes(rows, columns, forest, [0, 2, 9], [1, 4, 7], "v").collect()
            for r in votes:
                x = [r[c] for c in columns]
                shares = [sum(walk(trees[t], x, d) for t in range(n)) / n for d in (0, 2, 9) for n in (1, 4, 7)]
                assert r["v"] == [s > 0.5 for s in shares]
                assert shares[-1] == pytest.approx(want[r["appid"]])
    gone = rows.withColumn(columns[0], F.lit(None).cast("double"))
    assert mt.table_scores(gone, columns, table, kind).where("score is null or isnan(score)").count() == 0
    assert mt.table_scores(rows.limit(0), columns, table, kind).count() == 0
    with pytest.raises(ValueError):
        mt.kind_of(object())


def test_grid_search_query_covers_the_reference(spark, sf, monkeypatch):
    from catalog_queries import registry

    asked = {}

    def record(df, label, key, columns, depths, trees, folds=5, seed=42):
        asked.update(depths=list(depths), trees=list(trees), folds=folds)
        rows = [(d, n, 0.5, 1.0) for d in depths for n in trees]
        return df.sparkSession.createDataFrame(rows, "max_depth int, n_estimators int, mean_test_score double, mean_fit_time double")

    monkeypatch.setattr(models, "grid_search", record)
    assert registry()["grid_search"].run(spark, sf).count() == 25
    assert asked == {"depths": [8, 12, 16, 20, 24], "trees": [100, 200, 300, 400, 500], "folds": 5}


def test_draw_sample_is_the_head_of_the_draw_order(spark):
    df = spark.range(20_000)
    whole = [r["id"] for r in df.orderBy(skew.draw_order("id", 7)).limit(50).collect()]
    assert [r["id"] for r in skew.draw_sample(df, "id", 7, 50).collect()] == whole
    assert skew.draw_sample(spark.range(5), "id", 7, 50).count() == 5


def test_null_label_is_a_class_and_null_group_keeps_its_rows(spark):
    from shelfscope.operators.skew import draw_rank, exact_quantiles, running_totals
    from shelfscope.operators.split import downsample, stratified_split
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, float(i)) for i in range(90)], "id long, label int, x double")
    parts = {(r["label"], r["split"]): r["count"] for r in stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()}
    assert parts[None, "test"] == 6 and parts[None, "train"] == 24 and parts[1, "test"] == 6
    assert downsample(rows.where("id < 80 or label is null"), "label", "id").groupBy("label").count().select("count").distinct().count() == 1
    ranked = draw_rank(rows.withColumn("d", F.md5(F.col("id").cast("string"))), "label", "d", "r")
    assert sorted(r["r"] for r in ranked.where("label is null").collect()) == list(range(1, 31))
    totals = running_totals(rows.withColumn("n", F.lit(1)), "x", ["n"], ["label"])
    assert totals.count() == 90 and totals.where("label is null").agg(F.max("cum_n")).first()[0] == 30
    values = spark.range(20_000).select((F.col("id") * 1.5).alias("v"))
    assert exact_quantiles(values, "v", [0.25, 0.999], accuracy=50) == [19_999 * 0.25 * 1.5, 19_999 * 0.999 * 1.5]


def test_open_results_do_not_write_over_each_other(spark, sf):
    from catalog_queries import registry

    known = registry()
    first = known["csv_scan"].run(spark, sf)
    known["csv_search_scan"].run(spark, sf)
    assert first.count() > 0


def test_products_match_genres_as_written(spark):
    from shelfscope.operators.models import product_features

    specs = spark.sql("SELECT 1 AS id, 5.0 AS price, 1 AS release_month, array('windows') AS platforms, array('Massively Multiplayer', 'Action') AS genres")
    row = product_features(specs, ["genre_massively_multiplayer", "genre_action", "genre_rpg"]).first()
    assert tuple(row)[-3:] == (1.0, 1.0, 0.0)
