"""The product catalog derived from the given tables, and the registry of queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfscope.config import CatalogConfig
from shelfscope.operators import clean, features, labels
from shelfscope.session import checkpointed

CFG = CatalogConfig(
    as_of=dt.date(2001, 6, 30), min_total_reviews=20, hit_owners_min=1000.0, gem_wilson_min=0.60,
    gem_owners_below=1000.0, gem_min_reviews=25, anomaly_enabled=False, exclude_from_gem=False,
    owners_mid_floor=400.0,
)

# One text for both engines; table names are filled in by each of them.
GAMES_SQL = """
SELECT p.p_partkey AS appid, p.p_name AS name,
  CASE WHEN p.p_partkey % 7 = 0 THEN 0.0
       ELSE ROUND((p.p_retailprice - 900) * 1.2, 2) END AS price,
  CAST(p.p_size % 19 AS DOUBLE) AS required_age,
  CONCAT('[''', p.p_type, ''', ''', split_part(p.p_name, ' ', 2), ''']') AS genres,
  CONCAT('<''', split_part(p.p_name, ' ', 1), ''': ', CAST(p.p_size AS VARCHAR(10)),
         ', ''', p.p_brand, ''': 1>') AS tags_text,
  CONCAT('[''Studio ', CAST(p.p_partkey % 50 AS VARCHAR(10)), ''']') AS developers,
  CONCAT('[''Studio ', CAST(p.p_partkey % 30 AS VARCHAR(10)), ''']') AS publishers,
  p.p_partkey % 2 = 0 AS windows, p.p_partkey % 3 = 0 AS mac, p.p_partkey % 5 = 0 AS linux,
  l.positive, l.negative, l.recommendations,
  CONCAT(CAST(l.own_lo AS VARCHAR(20)), ' - ', CAST(l.own_lo + 200 AS VARCHAR(20))) AS estimated_owners,
  CAST(CAST('1996-01-01' AS DATE) + CAST(p.p_partkey * 37 % 2000 AS INT) AS TIMESTAMP) AS release_date,
  d.text AS short_description
FROM {part} p
JOIN (SELECT l_partkey,
        CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
        CAST(SUM(CASE WHEN l_returnflag =  'R' THEN 1 ELSE 0 END) AS BIGINT) AS negative,
        CAST(SUM(CASE WHEN l_returnflag =  'A' THEN 1 ELSE 0 END) AS BIGINT) AS recommendations,
        CAST(FLOOR(SUM(l_quantity) / 200) AS BIGINT) * 200 AS own_lo
      FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
LEFT JOIN {documents} d ON d.doc_id = p.p_partkey
"""

# The same catalog as it would arrive: copies, text dates in several spellings, dirty numbers.
RAW_SQL = """
SELECT t.appid, t.copy, t.name,
  CASE WHEN t.appid % 31 = 0 THEN 'free' ELSE CAST(t.price AS VARCHAR(20)) END AS price,
  CASE WHEN t.appid % 29 = 0 THEN '-3' WHEN t.appid % 23 = 0 THEN '99'
       ELSE CAST(t.required_age AS VARCHAR(20)) END AS required_age,
  CASE WHEN t.appid % 11 = 0 THEN 'n/a' ELSE CAST(t.appid % 4 AS VARCHAR(10)) END AS dlc_count,
  CASE WHEN t.appid % 12 = 0 THEN NULL ELSE CAST(t.appid % 40 AS VARCHAR(10)) END AS achievements,
  CASE WHEN t.appid % 5 = 0 THEN t.iso
       WHEN t.appid % 5 = 1 THEN CONCAT(t.mon, ' ', t.d, ', ', t.y)
       WHEN t.appid % 5 = 2 THEN CONCAT(t.d, ' ', t.mon, ', ', t.y)
       WHEN t.appid % 5 = 3 THEN REPLACE(t.iso, '-', '/')
       WHEN t.appid % 40 = 4 THEN 'coming soon'
       ELSE CONCAT(t.iso, ' 00:00:00') END AS release_date,
  t.genres, t.tags_text,
  CASE WHEN t.appid % 6 = 0 THEN NULL WHEN t.appid % 6 = 1 THEN 'nan'
       ELSE CONCAT('[''Single'', ''', SUBSTR(t.genres, 3, 3), ''']') END AS categories,
  CASE WHEN t.appid % 4 = 0 THEN NULL WHEN t.appid % 4 = 1 THEN '[''English'']'
       ELSE '[''English'', ''French'']' END AS supported_languages,
  CASE WHEN t.appid % 10 = 3 THEN NULL ELSE t.developers END AS developers,
  CASE WHEN t.appid % 10 = 3 OR t.appid % 14 = 5 THEN '[]' ELSE t.publishers END AS publishers,
  t.windows, t.mac, t.linux,
  CASE WHEN t.appid % 37 = 0 THEN NULL ELSE t.positive END AS positive,
  CASE WHEN t.appid % 41 = 0 THEN NULL ELSE t.negative END AS negative,
  CASE WHEN t.appid % 8 = 0 THEN NULL ELSE t.recommendations END AS recommendations,
  CASE WHEN t.appid % 17 = 0 THEN 'unknown'
       WHEN t.appid % 3 = 0 THEN REPLACE(t.estimated_owners, '00 ', ',00 ')
       ELSE t.estimated_owners END AS estimated_owners,
  t.short_description
FROM (SELECT g.*,
        CAST(CAST(g.release_date AS DATE) AS VARCHAR(10)) AS iso,
        CAST(year(g.release_date) AS VARCHAR(4)) AS y,
        CAST(day(g.release_date) AS VARCHAR(2)) AS d,
        split_part('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec', ' ', CAST(month(g.release_date) AS INT)) AS mon
      FROM (SELECT *, 0 AS copy FROM {games}
            UNION ALL SELECT *, 1 AS copy FROM {games} WHERE appid % 9 = 0) g) t
"""


def tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _with_tags(df: DataFrame) -> DataFrame:
    """Angle brackets stand for the braces of the dict literal."""
    from pyspark.sql import functions as F

    return df.withColumn("tags", F.translate("tags_text", "<>", "{}")).drop("tags_text")


def games(spark: SparkSession, sf: str) -> DataFrame:
    part, lineitem, documents = tables(spark, sf, "part", "lineitem", "documents")
    return _with_tags(spark.sql(GAMES_SQL, part=part, lineitem=lineitem, documents=documents))


def raw_games(spark: SparkSession, sf: str) -> DataFrame:
    part, lineitem, documents = tables(spark, sf, "part", "lineitem", "documents")
    base = spark.sql(GAMES_SQL, part=part, lineitem=lineitem, documents=documents)
    return _with_tags(spark.sql(RAW_SQL, games=base))


def _once(df: DataFrame, key: str) -> bool:
    """True if no value of the key repeats; nulls join with nothing."""
    return df.where(f"{key} is not null").groupBy(key).count().where("count > 1").isEmpty()


def cleaned(spark: SparkSession, sf: str, cfg: CatalogConfig = CFG) -> DataFrame:
    part, documents = tables(spark, sf, "part", "documents")
    unique = _once(part, "p_partkey") and _once(documents, "doc_id")
    return clean.clean(games(spark, sf), cfg, ["release_date", "name"], unique)


def labelled(spark: SparkSession, sf: str, cfg: CatalogConfig = CFG) -> DataFrame:
    return labels.make_labels(cleaned(spark, sf, cfg), cfg)


def stored_labels(spark: SparkSession, sf: str, cfg: CatalogConfig = CFG) -> DataFrame:
    """The labelled table, stored for operators that read it several times."""
    return checkpointed(labelled(spark, sf, cfg))


def engineered(spark: SparkSession, sf: str, cfg: CatalogConfig = CFG) -> DataFrame:
    return features.engineer(stored_labels(spark, sf, cfg), cfg)


# --- SQL twins -------------------------------------------------------------

GAMES = (
    "games AS (SELECT * EXCLUDE (tags_text), replace(replace(tags_text, '<', '{'), '>', '}') AS tags FROM ("
    + GAMES_SQL.format(part="part", lineitem="lineitem", documents="documents") + "))"
)
RAW = (
    GAMES + ",\nraw AS (SELECT * EXCLUDE (tags_text), replace(replace(tags_text, '<', '{'), '>', '}') AS tags FROM ("
    + RAW_SQL.format(games="(SELECT *, replace(replace(tags, '{', '<'), '}', '>') AS tags_text FROM games)") + "))"
)
CLEAN = GAMES + """,
cleaned AS (
  SELECT * EXCLUDE (price), LEAST(price, 100.0) AS price, positive + negative AS total_reviews_calc
  FROM games WHERE release_date <= TIMESTAMP '2001-01-01' AND positive + negative >= 20)"""
LABELLED = CLEAN + """,
rated AS (
  SELECT *, CAST(split_part(estimated_owners, ' - ', 1) AS DOUBLE) AS owners_lower,
    CAST(positive AS DOUBLE) / total_reviews_calc AS positive_ratio,
    (CAST(positive AS DOUBLE) / total_reviews_calc + 1.96 * 1.96 / (2 * total_reviews_calc)
      - 1.96 * sqrt(CAST(positive AS DOUBLE) / total_reviews_calc * (1 - CAST(positive AS DOUBLE) / total_reviews_calc)
          / total_reviews_calc + 1.96 * 1.96 / (4.0 * total_reviews_calc * total_reviews_calc)))
      / (1 + 1.96 * 1.96 / total_reviews_calc) AS wilson_lb
  FROM cleaned),
labelled AS (
  SELECT *, CASE WHEN owners_lower >= 1000 THEN 1 ELSE 0 END AS target_hit,
    CASE WHEN wilson_lb >= 0.60 AND owners_lower < 1000 AND total_reviews_calc >= 25 THEN 1 ELSE 0 END AS target_hidden_gem
  FROM rated)"""
FEATURES = LABELLED + """,
features AS (
  SELECT appid, name, genres, tags, short_description, price, required_age,
    CAST(windows AS INT) AS windows, CAST(mac AS INT) AS mac, CAST(linux AS INT) AS linux,
    CASE WHEN price = 0 THEN 1 ELSE 0 END AS is_free, ln(1 + price) AS log_price,
    CAST(windows AS INT) + CAST(mac AS INT) + CAST(linux AS INT) AS n_platforms,
    CAST(len(regexp_extract_all(genres, '''([^'']*)''', 1)) AS INT) AS n_genre,
    CAST(len(regexp_extract_all(tags, '''([^'']*)''', 1)) AS INT) AS n_tag,
    CAST(year(release_date) AS INT) AS release_year, CAST(month(release_date) AS INT) AS release_month,
    CAST(isodow(release_date) - 1 AS INT) AS release_dow,
    sin(2 * pi() * month(release_date) / 12) AS month_sin, cos(2 * pi() * month(release_date) / 12) AS month_cos,
    CASE WHEN month(release_date) >= 10 THEN 1 ELSE 0 END AS is_q4_release,
    CAST(count(*) OVER (PARTITION BY developers) AS BIGINT) AS developers_game_count,
    CAST(count(*) OVER (PARTITION BY publishers) AS BIGINT) AS publishers_game_count,
    CASE WHEN developers = publishers THEN 1 ELSE 0 END AS is_self_published,
    owners_lower, positive_ratio, wilson_lb, total_reviews_calc, target_hit, target_hidden_gem
  FROM labelled)"""
ITEMS = r"regexp_extract_all({c}, '''([^'']*)''', 1)"


def items(column: str) -> str:
    """DuckDB text for the items of a list or dict literal of plain quoted words."""
    return ITEMS.format(c=column)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` names the survey rows it shows."""
    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run
    return add
