"""End-to-end runs, and the physical plans of operators that must scale."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_queries import registry
from catalog_queries.base import CFG, games, labelled, raw_games, table
from shelfscope.operators import clean, features, models, search, tfidf
from shelfscope.plans import preprocess, search_index, training
from shelfscope.sources import raw_csv
from shelfscope.sources.tables import load_split


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_limits_keys_before_the_shuffle(spark, sf):
    text = plan(clean.first_per_key(games(spark, sf), "appid", ["name"]))
    assert "WindowGroupLimit" in text


def test_scan_reads_needed_columns_only(spark, sf):
    text = plan(labelled(spark, sf).select("appid", "wilson_lb"))
    assert "p_retailprice" not in text and "l_extendedprice" not in text and "text" not in text.replace("texts", "")


def test_filters_reach_the_scan(spark, sf):
    text = plan(games(spark, sf).where("appid > 100"))
    assert text.count("GreaterThan(p_partkey,100)") == 1 and "GreaterThan(l_partkey,100)" in text


def test_top_k_needs_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(registry()["confirmed_gems"].run(spark, sf))


def test_hits_are_limited_before_their_shuffle(spark, sf):
    docs = table(spark, sf, "documents")
    index = tfidf.fit_text_index(docs, "doc_id", "text", 200)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    text = plan(search.search(queries, "ml", 5, index=index))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # the only exchange carries each task's best hits; documents are weighed and met in place
    assert text.count("Exchange") == 1 and text.index("Exchange") < text.index("MapInArrow") and "Join" not in text


def test_relevance_shuffles_counts_only(spark, sf):
    text = plan(registry()["relevance_counts"].run(spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text and "doc_id" not in text


# the searches, their term weights, the encoder and scoring by trees, where Python workers are meant to run
PYTHON_QUERIES = {
    "keyword_search", "keyword_search_copies", "reranked_search", "facets_first_search", "plain_catalog_search", "precision_recall",
    "vector_search", "vector_search_blocked", "nearest_neighbours", "nearest_neighbours_by_cells", "oversampled",
    "encoded_texts", "evaluation_run", "mean_precision", "precision_table", "tfidf_postings", "tfidf_train_fitted",
    "scored_by_table", "keyword_search_indexed", "vector_search_indexed", "csv_split_scan",
    "screened_catalog", "labels_without_suspicious", "suspicious_rows"}


@pytest.mark.parametrize("name", [n for n, q in registry().items() if q.sql is not None and n not in PYTHON_QUERIES])
def test_sql_queries_stay_in_the_jvm(spark, sf, name):
    text = plan(registry()[name].run(spark, sf))
    assert not any(w in text for w in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"))


def test_vendor_counts_do_not_shuffle_the_wide_table(spark, sf):
    rows = labelled(spark, sf)
    made = features.engineer(rows, CFG)
    # one exchange for the lineitem aggregate, one for the dedupe
    assert plan(made).count("Exchange hashpartitioning") <= plan(rows).count("Exchange hashpartitioning")


def test_whole_run_from_csv(spark, sf, tmp_path):
    raw_csv.write_raw_csv(raw_games(spark, sf), f"{tmp_path}/raw")
    cfg = CFG.with_(anomaly_enabled=True, anomaly_trees=20, exclude_from_gem=True)
    done = preprocess.prepare_csv(spark, f"{tmp_path}/raw", cfg, f"{tmp_path}/out")
    meta = done.meta.first()
    assert meta["rows"] == done.catalog.count() == done.features.count()
    assert meta["leaked"] == ["positive", "negative", "recommendations", "estimated_owners"]
    assert not set(done.columns) & {"positive", "owners_lower", "wilson_lb", "is_suspicious", "appid"}
    assert {"n_languages", "n_cat", "achievements", "developers_game_count"} <= set(done.columns)
    assert done.splits.where("task = 'hit'").count() == done.features.count()
    train = done.splits.where("task = 'hidden_gem' AND split = 'train'").agg(F.avg("log_price"), F.stddev_pop("log_price")).first()
    assert train[0] == pytest.approx(0, abs=1e-6) and train[1] == pytest.approx(1, abs=1e-6)

    texts = load_split(spark, f"{tmp_path}/out/splits", "hit", f"{tmp_path}/out/text_hit")
    assert texts.where("task = 'hit'").count() == done.features.count() and texts.where("cardinality(text_weights) > 0").count() > 0
    length = texts.where("cardinality(text_weights) > 0").select(F.aggregate(F.map_values("text_weights"), F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    assert length.where("abs(n - 1) > 1e-9").count() == 0

    champions = spark.createDataFrame([], "task string, run_id string, value double, version int")
    comparison, decision = training.train_task(
        spark, f"{tmp_path}/out/splits", "hidden_gem", done.columns, champions, f"{tmp_path}/out", minimum=0.0,
        effort=models.Effort(trees=5, rounds=2, mlp_iterations=5, forest_depth=4, boost_depth=2), ml_only=True)
    assert comparison.count() == 5
    row = decision.first()
    assert row["promoted"] and row["reason"] == "first champion" and row["version"] == 1


def test_search_index_round_trip(spark, sf, tmp_path):
    encoder = lambda texts: np.array([[t.count(c) + 0.1 for c in "aeiou"] for t in texts], dtype=float)
    search_index.build_search_index(games(spark, sf), CFG, f"{tmp_path}/index", encoder)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    for method, extra in (("ml", {}), ("auto", {"encoder": encoder}), ("dl", {"encoder": encoder})):
        found = search_index.search_index(spark, queries, f"{tmp_path}/index", method, 3, max_price=1000, **extra)
        ranks = found.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
        assert ranks and all(r["m"] == r["n"] <= 3 for r in ranks)
    with pytest.raises(ValueError):
        search_index.search_index(spark, queries, f"{tmp_path}/index", "dl")
