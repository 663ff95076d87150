"""Text index, retrieval, re-ranking and retrieval evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog_queries.base import CFG, GAMES, RAW, games, items, query, raw_games, table
from catalog_queries.shaping import _folder, r6
from shelfscope.functions.text import STOP_WORDS
from shelfscope.functions.vectors import unit
from shelfscope.operators import inverted_index, retrieval_eval, search, tfidf, vector_index
from shelfscope.session import stored
from shelfscope.sources.tables import read_text_index, write_table, write_text_index

K = 20
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(name: str, source: str, key: str, text: str, ngram: int = 2) -> str:
    """DuckDB: (key, term, tf) of words and, if asked, bigrams."""
    return f"""
{name}_tok AS (SELECT {key}, list_filter(regexp_extract_all(lower(COALESCE({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM {source}),
{name}_gram AS (SELECT {key}, unnest(list_concat(w, {"list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])" if ngram > 1 else "[]"})) AS term FROM {name}_tok),
{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_gram GROUP BY ALL)"""


def vocabulary_sql(name: str, counts: str, source: str, terms: int) -> str:
    return f"""
{name} AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf
  FROM {counts} GROUP BY term ORDER BY cf DESC, term LIMIT {terms})"""


def weights_sql(name: str, counts: str, key: str, vocabulary: str) -> str:
    return f"""
{name} AS (SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS weight
  FROM {counts} JOIN {vocabulary} USING (term))"""


_DOC_INDEX = (terms_sql("dc", "documents", "doc_id", "text") + "," + vocabulary_sql("voc", "dc", "documents", CFG.search_terms)
              + "," + weights_sql("post", "dc", "doc_id", "voc"))
_BENCH = terms_sql("qc", "benchmark", "item_id", "text") + "," + weights_sql("qw", "qc", "item_id", "voc")
_SCORES = """
scores AS (SELECT item_id AS query_id, doc_id, round(sum(post.weight * qw.weight), 9) AS relevance FROM post JOIN qw USING (term) GROUP BY ALL)"""
_ML_TOP = """
ml AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= {k})"""


def _index(spark, sf):
    docs = table(spark, sf, "documents")
    return tfidf.fit_text_index(docs, "doc_id", "text", CFG.search_terms, CFG.ngram_max)


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("tfidf_vocabulary", "F8", "WITH " + _DOC_INDEX + "\nSELECT term, df, cf, round(idf, 6) + 0.0 AS idf FROM voc")
def tfidf_vocabulary(spark, sf):
    return _index(spark, sf).vocabulary.select("term", "df", "cf", r6("idf").alias("idf"))


@query("tfidf_postings", "F8 S7", "WITH " + _DOC_INDEX + "\nSELECT doc_id, term, round(weight, 6) + 0.0 AS weight FROM post")
def tfidf_postings(spark, sf):
    path = _folder(spark, sf, "text_index")
    write_text_index(_index(spark, sf), path)
    return read_text_index(spark, path).postings.select("doc_id", "term", r6("weight").alias("weight"))


@query("tfidf_train_fitted", "F8 F6", "WITH " + terms_sql("dc", "documents", "doc_id", "text") + """,
lab AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat(doc_id, '|42'))) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels),
train AS (SELECT doc_id FROM lab WHERE rk > round(n * 0.2)), tc AS (SELECT dc.* FROM dc JOIN train USING (doc_id)),"""
       + vocabulary_sql("voc", "tc", "train", CFG.tfidf_terms) + "," + weights_sql("post", "dc", "doc_id", "voc")
       + "\nSELECT doc_id, term, round(weight, 6) + 0.0 AS weight FROM post")
def tfidf_train_fitted(spark, sf):
    from shelfscope.operators.split import stratified_split

    docs = table(spark, sf, "documents").select("doc_id", "text")
    parts = stratified_split(table(spark, sf, "labels"), "quality", "doc_id", CFG.test_size, CFG.seed)
    train = docs.join(parts.where("split = 'train'").select("doc_id"), "doc_id", "left_semi")
    index = tfidf.fit_text_index(docs, "doc_id", "text", CFG.tfidf_terms, CFG.ngram_max, fit_on=train)
    return index.postings.select("doc_id", "term", r6("weight").alias("weight"))


@query("keyword_search", "F9 J6 T4 W4", "WITH " + _DOC_INDEX + "," + _BENCH + "," + _SCORES + "," + _ML_TOP.format(k=10)
       + "\nSELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, rank FROM ml")
def keyword_search(spark, sf):
    hits = search.search(_queries(spark, sf), "ml", 10, index=_index(spark, sf))
    return hits.select("query_id", "doc_id", r6("relevance").alias("relevance"), "rank")


@query("keyword_search_indexed", "F9 J6 S7 T4", "WITH " + _DOC_INDEX + "," + _BENCH + "," + _SCORES + "," + _ML_TOP.format(k=10)
       + "\nSELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, rank FROM ml")
def keyword_search_indexed(spark, sf):
    """The same search through the stored inverted index."""
    index = inverted_index.write_inverted_index(_index(spark, sf), _folder(spark, sf, "inverted"))
    hits = inverted_index.indexed_top(index, _queries(spark, sf), 10)
    return hits.select("query_id", "doc_id", r6("relevance").alias("relevance"), "rank")


@query("keyword_search_copies", "F9 J6 F13", "WITH " + RAW + """,
copies AS (SELECT appid, short_description, row_number() OVER () AS row_id FROM raw WHERE length(short_description) >= 20)""" + ","
       + terms_sql("dc", "copies", "row_id", "short_description") + "," + vocabulary_sql("voc", "dc", "copies", CFG.search_terms)
       + "," + weights_sql("post", "dc", "row_id", "voc") + "," + _BENCH + """,
scores AS (SELECT item_id AS query_id, row_id, round(sum(post.weight * qw.weight), 9) AS relevance FROM post JOIN qw USING (term) GROUP BY ALL),
ranked AS (SELECT query_id, appid, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, appid, row_id) AS INT) AS rank
  FROM scores JOIN copies USING (row_id))
SELECT query_id, appid, round(relevance, 6) + 0.0 AS relevance, rank FROM ranked WHERE rank <= 10""")
def keyword_search_copies(spark, sf):
    """The raw catalog, whose keys repeat: each copy is a document and a hit of its own."""
    raw = raw_games(spark, sf).select("appid", "short_description").where(F.length("short_description") >= 20)
    index = tfidf.fit_text_index(tfidf.with_row_id(raw, "copies"), "appid", "short_description", CFG.search_terms, CFG.ngram_max)
    hits = search.search(_queries(spark, sf), "ml", 10, index=index)
    return hits.select("query_id", F.col("doc_id").alias("appid"), r6("relevance").alias("relevance"), "rank")


# --- vectors ---------------------------------------------------------------

def _doc_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _label_queries(spark, sf):
    """One query per label: the mean direction of the label's vectors."""
    spread = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"))
    vector = F.transform("a", lambda s: s["x"])
    return rows.select(F.col("label").cast("long").alias("query_id"), unit(vector).alias("vector"))


_LABEL_QUERIES = """
lm AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, CAST(unnest(range(1, 65)) AS INT) AS i FROM embeddings) GROUP BY ALL),
lq AS (SELECT label AS query_id, list(x / n ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM lm) GROUP BY label),
dl_scores AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 9) AS relevance FROM embeddings, lq)"""
_DL_TOP = """
dl AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS INT) AS rank FROM dl_scores) WHERE rank <= {k})"""


@query("vector_search", "F9 J7 T4 W4", "WITH " + _LABEL_QUERIES + "," + _DL_TOP.format(k=10)
       + "\nSELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, rank FROM dl")
def vector_search(spark, sf):
    return search.vector_top(_doc_vectors(spark, sf), _label_queries(spark, sf), 10).select(
        "query_id", "doc_id", r6("relevance").alias("relevance"), "rank")


@query("vector_search_blocked", "J7 W4", "WITH " + _LABEL_QUERIES + "," + _DL_TOP.format(k=10)
       + "\nSELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, rank FROM dl")
def vector_search_blocked(spark, sf):
    """The same search by the route for query batches too large to broadcast."""
    hits = search.vector_top(_doc_vectors(spark, sf), _label_queries(spark, sf), 10, block=4, point_block=150)
    return hits.select("query_id", "doc_id", r6("relevance").alias("relevance"), "rank")


@query("vector_search_indexed", "F9 J7 S7 T4 W4", "WITH " + _LABEL_QUERIES + "," + _DL_TOP.format(k=10)
       + "\nSELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, rank FROM dl")
def vector_search_indexed(spark, sf):
    """The same search through the stored index, with the codes' error as the bound."""
    index = vector_index.write_vector_index(_doc_vectors(spark, sf), _folder(spark, sf, "vector_index"))
    hits = vector_index.exact_vector_top(index, _label_queries(spark, sf), 10)
    return hits.select("query_id", "doc_id", r6("relevance").alias("relevance"), "rank")


@query("vector_index_recall", "F9 J7 S7")
def vector_index_recall(spark, sf):
    """How many of the ten nearest the approximate search finds, for each vector whose id is divisible by 20."""
    docs = _doc_vectors(spark, sf)
    index = vector_index.write_vector_index(docs, _folder(spark, sf, "vector_index"))
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return vector_index.recall(vector_index.indexed_vector_top(index, queries, 10), search.vector_top(docs, queries, 10))


@query("unit_vectors", "F12 S7", """
SELECT vec_id, round(list_dot_product(v, v), 6) + 0.0 AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS first
FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 2)) AS u, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def unit_vectors(spark, sf):
    """Vectors of any length scaled back to one, stored, and read back."""
    raw = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("v"))
    made = write_table(raw.select("vec_id", unit("v").alias("u")), _folder(spark, sf, "unit_vectors"))
    square = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("vec_id", r6(square).alias("length"), r6(F.get("u", F.lit(0))).alias("first"))


def letter_encoder(texts: list[str]) -> np.ndarray:
    """A small stand-in encoder: letter frequencies."""
    return np.array([[t.count(c) for c in _LETTERS] for t in map(str.lower, texts)], dtype=float)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("encoded_texts", "F12", f"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
c AS (SELECT doc_id, list_transform(string_split('{",".join(_LETTERS)}', ','), lambda x: CAST(length(t) - length(replace(t, x, '')) AS DOUBLE)) AS v FROM t)
SELECT doc_id, CAST(len(v) AS INT) AS dimensions, round(CAST(CAST(CASE WHEN list_sum(v) = 0 THEN 0 ELSE v[5] / sqrt(list_dot_product(v, v)) END AS FLOAT) AS DOUBLE), 5) + 0.0 AS share_of_e FROM c""")
def encoded_texts(spark, sf):
    made = search.encode(table(spark, sf, "documents"), "doc_id", "text", letter_encoder)
    share = F.round(F.get("vector", F.lit(4)).cast("double"), 5) + F.lit(0.0)
    return made.select("doc_id", F.size("vector").alias("dimensions"), share.alias("share_of_e"))


# --- routing, facets, re-ranking -------------------------------------------

@query("routed_queries", "F11 X15", r"""
WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN text ELSE split_part(text, ' ', 1) || CASE WHEN conv_id % 3 = 0 THEN ' 무서운 게임' ELSE ' x' END END AS query FROM conversations),
s AS (SELECT *, regexp_matches(query, '[가-힣]') AS h, len(regexp_split_to_array(regexp_replace(query, '^\s+|\s+$', '', 'g'), '\s+')) <= 3 AS short FROM t)
SELECT conv_id, turn, CASE WHEN h THEN 'dl' WHEN short THEN 'ml' ELSE 'dl' END AS method,
  CASE WHEN h THEN 'hangul text' WHEN short THEN 'short keywords' ELSE 'natural language' END AS reason FROM s""")
def routed_queries(spark, sf):
    tail = F.when(F.col("conv_id") % 3 == 0, " 무서운 게임").otherwise(" x")
    short = F.concat(F.get(F.split("text", " "), F.lit(0)), tail)
    rows = table(spark, sf, "conversations").withColumn("query", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(short))
    return search.route(rows).select("conv_id", "turn", "method", "reason")


_CATALOG = GAMES + f""",
cat AS (SELECT appid, name, short_description, {items('tags')} AS tag_list, {items('genres')} AS genre_list, price,
    CASE WHEN positive + negative = 0 THEN 0.0 ELSE positive / (positive + negative) END AS positive_ratio,
    CAST(split_part(estimated_owners, ' - ', 1) AS DOUBLE) AS owners_lower, positive + negative AS total_reviews,
    windows, mac, linux, CAST(year(release_date) AS INT) AS release_year
  FROM games WHERE release_date <= TIMESTAMP '2001-01-01' AND positive + negative >= 20 AND length(short_description) >= 20)"""


def _catalog(spark, sf):
    return search.build_search_catalog(games(spark, sf), CFG)


@query("search_catalog", "F13 P9", "WITH " + _CATALOG + """
SELECT appid, name, md5(short_description) AS text_hash, tag_list, genre_list, price, round(positive_ratio, 6) + 0.0 AS positive_ratio,
  owners_lower, total_reviews, windows, mac, linux, release_year FROM cat""")
def search_catalog(spark, sf):
    return _catalog(spark, sf).withColumns({
        "text_hash": F.md5("short_description"), "positive_ratio": r6("positive_ratio")}).drop("short_description")


_CAT_INDEX = (terms_sql("dc", "cat", "appid", "short_description") + "," + vocabulary_sql("voc", "dc", "cat", CFG.search_terms)
              + "," + weights_sql("post", "dc", "appid", "voc"))
_CAT_SCORES = """
scores AS (SELECT item_id AS query_id, appid AS doc_id, round(sum(post.weight * qw.weight), 9) AS relevance FROM post JOIN qw USING (term) GROUP BY ALL)"""
_RERANK = """,
hits AS ({hits}),
pool AS (SELECT h.query_id, h.doc_id, h.relevance, c.* FROM hits h JOIN cat c ON c.appid = h.doc_id WHERE total_reviews >= 22 AND price <= 90 AND windows),
best AS (SELECT query_id, max(relevance) AS top, max(ln(1 + total_reviews)) AS most FROM pool GROUP BY 1),
scored AS (SELECT pool.*, round(0.7 * (relevance / (top + 1e-9)) + 0.3 * (COALESCE(ln(1 + total_reviews) / most, 0) * positive_ratio), 9) AS score FROM pool JOIN best USING (query_id))
SELECT * FROM (SELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, round(score, 6) + 0.0 AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY scored.score DESC, doc_id) AS INT) AS rank FROM scored) WHERE rank <= 10"""
_FACETS = {"min_reviews": 22, "max_price": 90, "platforms": ["windows"], "popularity_weight": 0.3}


def _searched(spark, sf, pool_factor, **facets):
    catalog = tfidf.with_row_id(_catalog(spark, sf), "search_catalog")
    index = tfidf.fit_text_index(catalog, "appid", "short_description", CFG.search_terms, CFG.ngram_max)
    found = search.search_catalog(
        _queries(spark, sf), catalog.withColumnRenamed("appid", "doc_id"), "ml", 10, pool_factor, index, **facets)
    return found.select("query_id", "doc_id", r6("relevance").alias("relevance"), r6("score").alias("score"), "rank")


@query("reranked_search", "F10 J3 P12 W5 T5", "WITH " + _CATALOG + "," + _CAT_INDEX + "," + _BENCH + "," + _CAT_SCORES
       + _RERANK.format(hits="SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) <= 150"))
def reranked_search(spark, sf):
    return _searched(spark, sf, 15, **_FACETS)


@query("facets_first_search", "F10 W5 T5", "WITH " + _CATALOG + "," + _CAT_INDEX + "," + _BENCH + "," + _CAT_SCORES
       + _RERANK.format(hits="SELECT * FROM scores"))
def facets_first_search(spark, sf):
    return _searched(spark, sf, None, **_FACETS)


@query("plain_catalog_search", "F10 F9", "WITH " + _CATALOG + "," + _CAT_INDEX + "," + _BENCH + "," + _CAT_SCORES + """
SELECT query_id, doc_id, round(relevance, 6) + 0.0 AS relevance, round(relevance, 6) + 0.0 AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY scores.relevance DESC, doc_id) AS INT) AS rank FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY scores.relevance DESC, doc_id) <= 10""")
def plain_catalog_search(spark, sf):
    return _searched(spark, sf, 15)


# --- evaluation ------------------------------------------------------------

_EVAL_INPUT = """
docs AS (SELECT doc_id, [lang, source] AS tag_list FROM documents),
eq AS (SELECT item_id AS query_id, text AS query, ['src' || CAST(item_id % 20 AS VARCHAR), CASE WHEN item_id % 4 = 0 THEN 'fr' ELSE 'none' END] AS gold,
  CASE WHEN length(text) < 200 THEN 'word' ELSE 'natural' END AS qtype FROM benchmark),
rel AS (SELECT query_id, count(*) AS relevant FROM eq JOIN docs ON list_has_any(docs.tag_list, eq.gold) GROUP BY 1),
dl_scores AS (SELECT eq.query_id, d.vec_id AS doc_id, round(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS relevance
  FROM eq JOIN embeddings q ON q.vec_id = eq.query_id CROSS JOIN embeddings d)"""


def _judged_sql(name: str, hits: str) -> str:
    return f"""
{name}_hit AS (SELECT h.query_id, count(*) FILTER (list_has_any(d.tag_list, e.gold)) AS hits FROM {hits} h JOIN docs d USING (doc_id) JOIN eq e USING (query_id) GROUP BY 1),
{name}_pr AS (SELECT eq.query_id, qtype, COALESCE(hits, 0) AS hits, COALESCE(relevant, 0) AS relevant, COALESCE(hits, 0) / {K}.0 AS precision,
  COALESCE(COALESCE(hits, 0) / relevant, 0.0) AS recall FROM eq LEFT JOIN {name}_hit USING (query_id) LEFT JOIN rel USING (query_id))"""


_EVAL = ("WITH " + _DOC_INDEX + "," + _BENCH + "," + _SCORES + "," + _ML_TOP.format(k=K) + "," + _EVAL_INPUT + "," + _DL_TOP.format(k=K)
         + "," + _judged_sql("ml", "ml") + "," + _judged_sql("dl", "dl") + """,
run AS (SELECT 'ML' AS method, qtype, query_id, round(precision, 3) AS precision, round(recall, 3) AS recall FROM ml_pr
  UNION ALL SELECT 'DL', qtype, query_id, round(precision, 3), round(recall, 3) FROM dl_pr)""")


def _eval_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tag_list"))
    gold = F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")),
                   F.when(F.col("item_id") % 4 == 0, "fr").otherwise("none"))
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), gold.alias("gold"),
        F.when(F.length("text") < 200, "word").otherwise("natural").alias("qtype"))
    return docs, queries


def _run(spark, sf):
    docs, queries = _eval_tables(spark, sf)
    vectors = _doc_vectors(spark, sf)
    query_vectors = vectors.withColumnRenamed("doc_id", "query_id")
    hits = {
        "ML": search.search(queries, "ml", K, index=_index(spark, sf)),
        "DL": search.search(queries, "dl", K, doc_vectors=vectors, query_vectors=query_vectors),
    }
    return retrieval_eval.evaluation_run(hits, docs, queries, K)


@query("relevance_counts", "J5", "WITH " + _EVAL_INPUT + "\nSELECT query_id, relevant FROM rel")
def relevance_counts(spark, sf):
    return retrieval_eval.relevant_counts(*_eval_tables(spark, sf))


@query("precision_recall", "F14 J5", _EVAL + "\nSELECT query_id, hits, relevant, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall FROM ml_pr")
def precision_recall(spark, sf):
    docs, queries = _eval_tables(spark, sf)
    hits = search.search(queries, "ml", K, index=_index(spark, sf))
    made = retrieval_eval.precision_recall(hits, docs, queries, K)
    return made.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query("evaluation_run", "F15 F14", _EVAL + "\nSELECT * FROM run")
def evaluation_run(spark, sf):
    return _run(spark, sf)


@query("mean_precision", "A17", _EVAL + """
SELECT method, 'all' AS qtype, round(avg(precision), 6) + 0.0 AS mean_precision FROM run GROUP BY 1
UNION ALL SELECT method, qtype, round(avg(precision), 6) + 0.0 FROM run GROUP BY 1, 2""")
def mean_precision(spark, sf):
    run = stored(_run(spark, sf), "evaluation")
    whole = retrieval_eval.mean_precision(run, "method").withColumn("qtype", F.lit("all"))
    return whole.unionByName(retrieval_eval.mean_precision(run, "method", "qtype")).withColumn("mean_precision", r6("mean_precision"))


@query("precision_table", "A16", _EVAL + """
SELECT t.qtype, t.row_order, round(avg(precision) FILTER (method = 'ML'), 3) AS "ML", round(avg(precision) FILTER (method = 'DL'), 3) AS "DL"
FROM (VALUES (0, 'word'), (1, 'natural'), (2, 'korean')) t(row_order, qtype) LEFT JOIN run USING (qtype) GROUP BY ALL""")
def precision_table(spark, sf):
    return retrieval_eval.precision_table(_run(spark, sf), ["ML", "DL"], ["word", "natural", "korean"])
