"""Search catalog, keyword index and, with an encoder, vector index, stored together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.operators import search, tfidf
from shelfscope.sources.tables import read_table, read_text_index, write_table, write_text_index


def build_search_index(raw: DataFrame, cfg: CatalogConfig, out: str, encoder: Callable | None = None) -> None:
    # copies of a product are rows of their own, told apart by their place in the stored catalog
    numbered = search.build_search_catalog(raw, cfg).withColumn("row_id", F.monotonically_increasing_id())
    catalog = write_table(numbered, f"{out}/catalog")
    texts = catalog.select("appid", "row_id", "short_description")
    write_text_index(tfidf.fit_text_index(texts, "appid", "short_description", cfg.search_terms, cfg.ngram_max), f"{out}/text")
    if encoder is not None:
        vectors = search.encode(texts, ["appid", "row_id"], "short_description", encoder).withColumnRenamed("appid", "doc_id")
        write_table(vectors, f"{out}/vectors")


def search_index(spark: SparkSession, queries: DataFrame, out: str, method: str = "auto", k: int = 10,
                 encoder: Callable | None = None, **facets) -> DataFrame:
    """Answer a (query_id, query) table from a stored index."""
    catalog = read_table(spark, f"{out}/catalog").withColumnRenamed("appid", "doc_id")
    vectors = queries_ = None
    if method != "ml":
        if encoder is None:
            raise ValueError(f"method {method!r} needs the encoder the index was built with")
        vectors = read_table(spark, f"{out}/vectors")
        queries_ = search.encode(queries, "query_id", "query", encoder)
    return search.search_catalog(
        queries, catalog, method, k, index=read_text_index(spark, f"{out}/text"),
        doc_vectors=vectors, query_vectors=queries_, **facets)
