"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: End id that the token files get after each document.
END_ID = 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op3_token_planes(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.token_planes import token_table

    return token_table(spark, _table(spark, sf, "documents"), vocabulary(), END_ID)


MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS w FROM per),
stepped AS (
  SELECT *, COALESCE(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM weighed),
level AS (
  SELECT (total - capped) / left_w AS level FROM stepped WHERE (total - capped) / left_w < cap / w
  ORDER BY cap / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, level * w) AS target,
    CASE WHEN source_size > 0 THEN least(cap, level * w) / source_size ELSE 0.0 END AS each,
    CAST('0x' || substr(md5('17' || COALESCE('=' || source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM weighed, level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS n FROM sized)
SELECT doc_id, size, t.source_size, t.target,
  CAST(size * (floor(n * each + u) - floor((n - 1) * each + u)) AS BIGINT) AS taken
FROM numbered d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
"""


@_query(MIXING)
def op8_source_mixture(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.mixing import mixture

    mix = mixture(_table(spark, sf, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingled x JOIN shingled y
  ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@_query(NEAR_DUPLICATES)
def op1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf, "documents"))


CONTAINED = r"""
WITH split AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM split),
shingled AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle FROM worded),
sizes AS (SELECT id, count(*) AS item_shingles FROM shingled WHERE side = 1 GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM shingled d JOIN shingled i
  ON d.shingle = i.shingle AND d.side = 0 AND i.side = 1 GROUP BY d.id, i.id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM shared JOIN sizes ON id = item_id WHERE 100 * shared >= 75 * item_shingles
"""


@_query(CONTAINED)
def op5_benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.decontaminate import contained_items

    return contained_items(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).drop("text_key")


@_query()
def op4_language_spans(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.common import held_out
    from shelfscope.llm.language import fit_and_identify

    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    found = fit_and_identify(docs, ~F.col("held_out"))
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score", F.size("language.spans").alias("n_spans"))


@_query()
def op9_context_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.common import held_out
    from shelfscope.llm.context_tree import scored

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return scored(docs, ~held_out(F.col("doc_id"), 10, 0))


@_query()
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.common import held_out
    from shelfscope.llm.quality_rules import scored

    docs, out = _table(spark, sf, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 3, 1)
    found = scored(docs, _table(spark, sf, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


@_query()
def op10_toxicity_machine(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.common import held_out
    from shelfscope.llm.toxicity_fm import scored

    docs = _table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    return scored(docs, _table(spark, sf, "labels"), ~F.col("held_out"))


#: Key of the registered query's pseudonyms; a run of one's own passes a secret one.
PSEUDONYM_KEY = b"registered query"


@_query()
def op7_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.pii import pseudonyms

    found = pseudonyms(_table(spark, sf, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("replaced").alias("n_replaced"), "replaced")


TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query(TOP_K)
def op6_voronoi_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.knn import voronoi_knn

    return voronoi_knn(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


SPELLING = r"""
WITH RECURSIVE bits(i, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs GROUP BY ALL),
coded AS (
  SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
  FROM lowered),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1)))) AS h FROM coded, crc_table),
damaged AS (
  SELECT times, CASE WHEN h % 31 = 0
    THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM shorter x JOIN shorter y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON x.rest = y.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
followed(word, reached) AS (
  SELECT word, word FROM formed
  UNION SELECT f.word, g.form FROM followed f JOIN formed g ON f.reached = g.word WHERE g.form IS NOT NULL)
SELECT d.word, d.form, f.reached AS root, d.n, d.n_near, d.form_n
FROM formed d JOIN followed f ON f.word = d.word JOIN formed e ON e.word = f.reached AND e.form IS NULL
"""


@_query(SPELLING)
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf, "documents"))


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query()
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.token_alignment import alignment_table

    return alignment_table(_table(spark, sf, "documents"), vocabulary(), piece_vocabulary())


@_query()
def op13_piecewise_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from shelfscope.llm.piecewise_hash import neighbour_fingerprints

    return neighbour_fingerprints(_table(spark, sf, "documents"))
