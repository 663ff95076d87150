"""The stored vector index against the search over all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_queries.base import table
from shelfscope.operators import search, vector_index
from shelfscope.sources.tables import write_table


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["row_id"], round(r["relevance"], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.write_vector_index(vectors, str(tmp_path_factory.mktemp("index")))


def test_recall_of_the_index(vectors, queries, index):
    assert index.entries.count() == vectors.count()
    exact = search.vector_top(vectors, queries, 10)
    found = vector_index.indexed_vector_top(index, queries, 10)
    measured = vector_index.recall(found, exact).agg(F.avg("recall"), F.min("wanted"), F.count("*")).first()
    print("recall", measured)
    assert measured[0] >= 0.9 and measured[1] == 10 and measured[2] == queries.count()
    scores = {(r["query_id"], r["row_id"]): r["relevance"] for r in exact.collect()}
    for r in found.collect():
        assert scores.get((r["query_id"], r["row_id"]), r["relevance"]) == pytest.approx(r["relevance"], abs=2e-9)


def test_bounded_search_is_exact(vectors, queries, index):
    want = _rows(search.vector_top(vectors, queries, 10))
    assert _rows(vector_index.exact_vector_top(index, queries, 10)) == want
    # a poor first answer gives a low bar, and the same result
    assert _rows(vector_index.exact_vector_top(index, queries, 10, probed=0.01, refine=1)) == want


def test_blocks_of_queries_agree(queries, index, monkeypatch):
    want = _rows(vector_index.indexed_vector_top(index, queries, 5))
    monkeypatch.setattr(vector_index, "QUERIES", 30)
    assert _rows(vector_index.indexed_vector_top(index, queries, 5, point_block=700)) == want


def test_codes_are_read_without_vectors(queries, index):
    few = queries.limit(1)
    text = vector_index.indexed_vector_top(index, few, 3, probed=0.05)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text or "bucket#" in text.split("PartitionFilters", 1)[1][:200]


def test_the_bound_holds(vectors, index):
    q = index.quantiser
    x = np.array([r["vector"] for r in vectors.limit(300).collect()])
    cell, codes, err = q.encode(x)
    back = q.centres[cell] + np.concatenate([q.words[p][codes[:, p]] for p in range(len(q.words))], axis=1)[:, :x.shape[1]]
    assert np.allclose(np.sqrt(((x - back) ** 2).sum(1)), err)


def test_copies_nulls_odd_sizes_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, i, (rng.normal(size=10) if i % 3 else np.ones(10)).tolist()) for i in range(300)] + [(7, 300, None), (7, 301, [0.5] * 10)]
    docs = spark.createDataFrame(data, "doc_id long, row_id long, vector array<double>")
    made = vector_index.write_vector_index(write_table(docs, f"{tmp_path}/docs"), f"{tmp_path}/index", parts=4)
    asked = docs.where("row_id in (0, 1, 2, 300)").select(F.col("row_id").alias("query_id"), "vector")
    want = _rows(search.vector_top(docs, asked, 20))
    assert _rows(vector_index.exact_vector_top(made, asked, 20)) == want and {r[0] for r in want} == {0, 1, 2}
    none = vector_index.write_vector_index(docs.limit(0), f"{tmp_path}/none")
    assert vector_index.indexed_vector_top(none, asked, 3).count() == vector_index.exact_vector_top(none, asked, 3).count() == 0
    assert vector_index.indexed_vector_top(made, asked.limit(0), 3).count() == 0
