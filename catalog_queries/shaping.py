"""Sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from catalog_queries.base import (
    CFG, CLEAN, FEATURES, GAMES, LABELLED, RAW, cleaned, engineered, games, items, labelled, query, raw_games, table)
from shelfscope.functions import scalars as X
from shelfscope.operators import clean, features, reports, search, split
from shelfscope.session import shared_dir
from shelfscope.sources import normalise, raw_csv
from shelfscope.sources import tables as T


def r6(c):
    return F.round(X.col(c), 6) + F.lit(0.0)


def _folder(spark, sf, name):
    """A fresh folder: results are lazy, so no later call may write over what an open one reads."""
    return f"{shared_dir(spark)}/queries/{sf.rstrip('/').rsplit('/', 1)[-1]}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------

def _as_csv(spark, sf):
    """The raw catalog as one CSV with heavy columns that must be skipped."""
    path = _folder(spark, sf, "raw_csv")
    heavy = {c: F.concat(F.lit(c + ', "quoted"\n'), "name") for c in ("about_the_game", "reviews", "notes")}
    raw_csv.write_raw_csv(raw_games(spark, sf).withColumns(heavy), path)
    return path


RAW_CSV_SQL = "WITH " + RAW + """
SELECT appid, copy, name, price, required_age, release_date, genres, tags, windows, mac, linux,
  positive, negative, estimated_owners, md5(short_description) AS text_hash FROM raw"""


@query("csv_scan", "S1 S4", RAW_CSV_SQL)
def csv_scan(spark, sf):
    rows = raw_csv.read_raw_csv(spark, _as_csv(spark, sf))
    return rows.select(
        "appid", F.col("copy").cast("int").alias("copy"), "name", "price", "required_age", "release_date", "genres",
        "tags", "windows", "mac", "linux", "positive", "negative", "estimated_owners",
        F.md5("short_description").alias("text_hash"))


@query("csv_split_scan", "S1 S2", "WITH " + RAW + """
SELECT appid, name, md5(short_description) AS text_hash, tags, genres, price, positive, negative,
  estimated_owners, windows, mac, linux, release_date FROM raw""")
def csv_split_scan(spark, sf):
    """The same texts with line breaks, read by many tasks from byte ranges of the files."""
    rows = raw_csv.read_search_csv(spark, _as_csv(spark, sf), split_files=True)
    return rows.withColumn("text_hash", F.md5("short_description")).drop("short_description")


@query("csv_search_scan", "S2", "WITH " + RAW + """
SELECT appid, name, md5(short_description) AS text_hash, tags, genres, price, positive, negative,
  estimated_owners, windows, mac, linux, release_date FROM raw""")
def csv_search_scan(spark, sf):
    rows = raw_csv.read_search_csv(spark, _as_csv(spark, sf))
    return rows.withColumn("text_hash", F.md5("short_description")).drop("short_description")


@query("parquet_scan", "S3", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_scan(spark, sf):
    return T.read_table(spark, f"{sf}/part.parquet").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("parquet_round_trip", "S4 S9", "WITH " + LABELLED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_hit ORDER BY md5(concat(appid, '|42'))) AS rk,
    count(*) OVER (PARTITION BY target_hit) AS n FROM labelled)
SELECT appid, price, target_hit FROM ranked WHERE rk > round(n * 0.2)""")
def parquet_round_trip(spark, sf):
    rows = split.stratified_split(labelled(spark, sf), "target_hit", "appid", CFG.test_size, CFG.seed)
    path = _folder(spark, sf, "splits")
    T.write_table(rows.select("appid", "price", "target_hit", "split", F.lit("hit").alias("task")), path, ["task", "split"])
    return T.load_split(spark, path, "hit").where("split = 'train'").select("appid", "price", "target_hit")


@query("json_round_trip", "S5 S6", "WITH " + LABELLED + """
SELECT release_year, n, round(hit_rate, 6) + 0.0 AS hit_rate FROM (
  SELECT CAST(year(release_date) AS INT) AS release_year, count(*) AS n, avg(target_hit) AS hit_rate FROM labelled GROUP BY 1)""")
def json_round_trip(spark, sf):
    summary = labelled(spark, sf).groupBy(F.year("release_date").alias("release_year")).agg(
        F.count("*").alias("n"), F.avg("target_hit").alias("hit_rate"))
    path = _folder(spark, sf, "summary_json")
    T.write_json(summary, path)
    back = T.read_json(spark, path, "release_year int, n long, hit_rate double")
    return back.select("release_year", "n", r6("hit_rate").alias("hit_rate"))


def _aliased(spark, sf):
    g = games(spark, sf)
    return g.select(
        "appid", F.col("name").alias("title"), F.col("price").cast("string").alias("price"),
        F.when(F.col("appid") % 6 == 0, None).when(F.col("appid") % 6 == 1, "n/a")
        .otherwise(F.year("release_date").cast("string")).alias("year"),
        (F.col("price") == 0).cast("string").alias("unused"),
        (F.col("appid") % 2).cast("string").alias("isfree"),
        F.col("required_age").cast("string").alias("requiredage"))


_ALIASED = GAMES + """,
aliased AS (SELECT appid, name, CAST(price AS DOUBLE) AS price,
    CASE WHEN appid % 6 = 0 THEN NULL WHEN appid % 6 = 1 THEN NULL ELSE CAST(year(release_date) AS INT) END AS y,
    CAST(appid % 2 AS INT) AS is_free, CAST(required_age AS INT) AS required_age FROM games)"""


@query("schema_normalised_drop", "S8", "WITH " + _ALIASED + """
SELECT appid, name, price, is_free, required_age, y AS release_year FROM aliased WHERE y IS NOT NULL""")
def schema_normalised_drop(spark, sf):
    return normalise.normalise_schema(_aliased(spark, sf), "drop").drop("unused")


@query("schema_normalised_zero", "S8", "WITH " + _ALIASED + """
SELECT appid, name, price, is_free, required_age, COALESCE(y, 0) AS release_year FROM aliased""")
def schema_normalised_zero(spark, sf):
    return normalise.normalise_schema(_aliased(spark, sf), "zero").drop("unused")


# --- projections and filters -----------------------------------------------

@query("leakage_guard", "P1", "WITH " + FEATURES + """
SELECT f.appid, f.price, f.target_hit, f.target_hidden_gem, f.developers_game_count,
  'positive,negative,recommendations,estimated_owners' AS leaked FROM features f""")
def leakage_guard(spark, sf):
    guarded, leaked = features.leakage_guard(engineered(spark, sf), CFG)
    return guarded.select("appid", "price", "target_hit", "target_hidden_gem", "developers_game_count",
                          F.lit(",".join(leaked)).alias("leaked"))


@query("columns_by_name", "P2", "WITH " + LABELLED + f"""
SELECT appid, target_hit, target_hidden_gem,
  CAST(len(list_distinct({items('genres')})) AS INT) AS genre_hits FROM labelled""")
def columns_by_name(spark, sf):
    df = features.multi_hot(labelled(spark, sf), "genres", "genre", CFG.top_genres)
    genre = features.columns_like(df, prefix="genre_")
    targets = features.columns_like(df, prefix="target_")
    return df.select("appid", *targets, sum([F.col(c) for c in genre], F.lit(0)).alias("genre_hits"))


@query("columns_by_part", "P2", "WITH " + FEATURES + """
SELECT appid, price, round(log_price, 6) + 0.0 AS log_price, n_platforms FROM features""")
def columns_by_part(spark, sf):
    """The first three of the columns whose names hold a part: their order is the table's."""
    rows = engineered(spark, sf)
    named = features.columns_like(rows, parts=("price", "platforms"), first=3)
    return rows.select("appid", *named).withColumn("log_price", r6("log_price"))


@query("float_features", "P3", "WITH " + FEATURES + """
SELECT appid, CAST(price AS FLOAT) AS price, CAST(n_platforms AS FLOAT) AS n_platforms,
  CAST(developers_game_count AS FLOAT) AS developers_game_count FROM features""")
def float_features(spark, sf):
    columns = ["price", "n_platforms", "developers_game_count"]
    return features.as_float(engineered(spark, sf), columns).select("appid", *columns)


@query("coerced_numbers", "P4 P6", "WITH " + RAW + """
SELECT appid, copy, COALESCE(TRY_CAST(price AS DOUBLE), 0.0) AS price,
  LEAST(COALESCE(TRY_CAST(price AS DOUBLE), 0.0), 100.0) AS clipped_price,
  GREATEST(LEAST(COALESCE(TRY_CAST(required_age AS DOUBLE), 0.0), 21.0), 0.0) AS required_age,
  COALESCE(TRY_CAST(dlc_count AS DOUBLE), 0.0) AS dlc_count,
  COALESCE(TRY_CAST(achievements AS DOUBLE), 0.0) AS achievements FROM raw""")
def coerced_numbers(spark, sf):
    return raw_games(spark, sf).select(
        "appid", "copy", X.to_number("price").alias("price"),
        X.clip(X.to_number("price"), upper=CFG.price_clip_max).alias("clipped_price"),
        X.clip(X.to_number("required_age"), 0.0, float(CFG.max_age_rating)).alias("required_age"),
        X.to_number("dlc_count").alias("dlc_count"), X.to_number("achievements").alias("achievements"))


_PARSED_DATE = """COALESCE(try_strptime(release_date, '%Y-%m-%d'), try_strptime(release_date, '%Y-%m-%d %H:%M:%S'),
  try_strptime(release_date, '%b %d, %Y'), try_strptime(release_date, '%d %b, %Y'), try_strptime(release_date, '%Y/%m/%d'))"""


@query("parsed_dates", "P5", "WITH " + RAW + f"""
SELECT appid, copy, CAST({_PARSED_DATE} AS DATE) AS release_date FROM raw WHERE {_PARSED_DATE} IS NOT NULL""")
def parsed_dates(spark, sf):
    dated = raw_games(spark, sf).withColumn("release_date", X.parse_release_date("release_date"))
    return dated.where(F.col("release_date").isNotNull()).select(
        "appid", "copy", F.col("release_date").cast("date").alias("release_date"))


@query("mature_rows", "P7", "WITH " + GAMES + """
SELECT appid, CAST(release_date AS DATE) AS release_date FROM games WHERE release_date <= TIMESTAMP '2001-01-01'""")
def mature_rows(spark, sf):
    old = clean.mature("release_date", CFG.as_of, CFG.min_days_since_release)
    return games(spark, sf).where(old).select("appid", F.col("release_date").cast("date").alias("release_date"))


@query("reviewed_rows", "P8", "WITH " + RAW + """
SELECT appid, copy, COALESCE(positive, 0) + COALESCE(negative, 0) AS total_reviews FROM raw
WHERE COALESCE(positive, 0) + COALESCE(negative, 0) >= 20""")
def reviewed_rows(spark, sf):
    total = X.total_reviews("positive", "negative")
    return raw_games(spark, sf).select("appid", "copy", total.alias("total_reviews")).where(
        F.col("total_reviews") >= CFG.min_total_reviews)


@query("described_rows", "P9", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND length(text) >= 20")
def described_rows(spark, sf):
    return table(spark, sf, "documents").where(F.length("text") >= CFG.min_description_chars).select("doc_id", "lang")


def _view_table(spark, sf):
    return games(spark, sf).withColumns({
        "is_free": (F.col("price") == 0).cast("int"), "release_year": F.year("release_date")})


@query("named_views", "P10", "WITH " + GAMES + """,
v AS (SELECT appid, CASE WHEN price = 0 THEN 1 ELSE 0 END AS is_free, CAST(year(release_date) AS INT) AS y FROM games)
SELECT 'all' AS view, appid FROM v UNION ALL SELECT 'genre', appid FROM v
UNION ALL SELECT 'free', appid FROM v WHERE is_free = 1 UNION ALL SELECT 'paid', appid FROM v WHERE is_free = 0
UNION ALL SELECT 'new', appid FROM v WHERE y = (SELECT max(y) FROM v)""")
def named_views(spark, sf):
    return reports.in_views(_view_table(spark, sf)).select("view", "appid")


@query("catalog_facets", "P11", "WITH " + GAMES + """
SELECT appid, price FROM games WHERE price <= 60 AND windows AND (genres LIKE '%PROMO%' OR genres LIKE '%ring%')""")
def catalog_facets(spark, sf):
    return games(spark, sf).where(reports.catalog_facets(60, ["windows"], ["PROMO", "ring"])).select("appid", "price")


@query("hit_facets", "P12", "WITH " + CLEAN + """
SELECT appid, price, total_reviews_calc AS total_reviews FROM cleaned
WHERE total_reviews_calc >= 25 AND price <= 80 AND windows AND mac""")
def hit_facets(spark, sf):
    rows = cleaned(spark, sf).withColumnRenamed("total_reviews_calc", "total_reviews")
    return rows.where(search.hit_facets(25, 80, ["windows", "mac"])).select("appid", "price", "total_reviews")


@query("name_search", "P13", "WITH " + GAMES + """
SELECT appid, name, price FROM games WHERE regexp_matches(name, '(?i)BLUE|g.zmo') ORDER BY appid LIMIT 20""")
def name_search(spark, sf):
    return reports.find_by_name(games(spark, sf), "BLUE|g.zmo", 20).select("appid", "name", "price")


@query("cleaning_funnel", "P14 A1", "WITH " + RAW + f""",
firsts AS (SELECT *, {_PARSED_DATE} AS d, COALESCE(positive, 0) + COALESCE(negative, 0) AS r,
    COALESCE(TRY_CAST(price AS DOUBLE), 0.0) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY copy) AS rn FROM raw) WHERE rn = 1)
SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM raw) - count(*) AS duplicates_removed,
  count(*) FILTER (d IS NULL) AS bad_dates_removed,
  count(*) FILTER (d > TIMESTAMP '2001-01-01') AS too_recent_removed,
  count(*) FILTER (d <= TIMESTAMP '2001-01-01' AND r < 20) AS too_few_reviews_removed,
  count(*) FILTER (d <= TIMESTAMP '2001-01-01' AND r >= 20 AND p > 100) AS prices_clipped,
  count(*) FILTER (d <= TIMESTAMP '2001-01-01' AND r >= 20) AS rows_out,
  round(count(*) FILTER (d <= TIMESTAMP '2001-01-01' AND r >= 20) / (SELECT count(*) FROM raw), 6) + 0.0 AS kept_share
FROM firsts""")
def cleaning_funnel(spark, sf):
    return clean.cleaning_funnel(raw_games(spark, sf), CFG, ["copy"]).withColumn("kept_share", r6("kept_share"))


#: Parts of the catalog that are dealt over 2, 7 or 13 tasks; a larger catalog takes as many more, so that no task's share grows.
DEALT_PARTS = 50_000


@query("tied_copies", "A1 P14", "WITH " + RAW + f""",
tied AS (SELECT * REPLACE (positive - 15 * copy AS positive) FROM raw),
firsts AS (SELECT *, {_PARSED_DATE} AS d, COALESCE(positive, 0) + COALESCE(negative, 0) AS r
  FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY name NULLS FIRST, release_date NULLS FIRST, positive NULLS FIRST,
    negative NULLS FIRST, price NULLS FIRST) AS rn FROM tied) WHERE rn = 1),
kept AS (SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS r FROM firsts WHERE d <= TIMESTAMP '2001-01-01' AND r >= 20)
SELECT n AS funnel_rows, n AS rows_in_few_parts, r AS reviews_in_few_parts, n AS rows_in_many_parts, r AS reviews_in_many_parts FROM kept""")
def tied_copies(spark, sf):
    """Copies that tie in the stated order but differ in their reviews: the funnel and the table agree, however they are dealt."""
    rows = raw_games(spark, sf).withColumn("positive", F.col("positive") - F.lit(15) * F.col("copy"))
    deals = math.ceil(max(1, table(spark, sf, "part").count()) / DEALT_PARTS)
    out = clean.cleaning_funnel(rows.repartition(7 * deals), CFG, ["name"]).select(F.col("rows_out").alias("funnel_rows"))
    for parts, name in ((2, "few"), (13, "many")):
        kept = clean.clean(rows.repartition(parts * deals), CFG, ["name"])
        out = out.join(F.broadcast(kept.agg(
            F.count("*").alias(f"rows_in_{name}_parts"), F.sum("total_reviews_calc").alias(f"reviews_in_{name}_parts"))))
    return out


@query("cleaned_rows", "A1 P4 P5 P6 P7 P8", "WITH " + RAW + f"""
SELECT appid, CAST(d AS DATE) AS release_date, r AS total_reviews_calc, LEAST(p, 100.0) AS price,
  GREATEST(LEAST(COALESCE(TRY_CAST(required_age AS DOUBLE), 0.0), 21.0), 0.0) AS required_age
FROM (SELECT *, {_PARSED_DATE} AS d, COALESCE(positive, 0) + COALESCE(negative, 0) AS r,
    COALESCE(TRY_CAST(price AS DOUBLE), 0.0) AS p, row_number() OVER (PARTITION BY appid ORDER BY copy) AS rn FROM raw)
WHERE rn = 1 AND d <= TIMESTAMP '2001-01-01' AND r >= 20""")
def cleaned_rows(spark, sf):
    return clean.clean(raw_games(spark, sf), CFG, ["copy"]).select(
        "appid", F.col("release_date").cast("date").alias("release_date"), "total_reviews_calc", "price", "required_age")


@query("first_copies", "A1", "WITH " + RAW + """
SELECT appid, copy FROM raw QUALIFY row_number() OVER (PARTITION BY appid ORDER BY copy DESC) = 1""")
def first_copies(spark, sf):
    return clean.first_per_key(raw_games(spark, sf).select("appid", "copy"), "appid", [F.desc("copy")])


_YEAR_TEXT = """CASE WHEN appid % 5 = 0 THEN '-' || CAST(appid % 9 AS VARCHAR(5)) WHEN appid % 5 = 1 THEN CAST(appid % 25 AS VARCHAR(5))
  WHEN appid % 5 = 2 THEN 'soon' WHEN appid % 5 = 3 THEN CAST(year(release_date) AS VARCHAR(5)) || '.0' ELSE CAST(year(release_date) AS VARCHAR(5)) END"""


@query("repaired_years", "P15", "WITH " + GAMES + f""",
t AS (SELECT appid, CAST(TRY_CAST({_YEAR_TEXT} AS DOUBLE) AS INT) AS y FROM games)
SELECT appid, CASE WHEN y < 0 THEN 2013 + abs(y) WHEN y < 100 THEN 2000 + y ELSE y END AS release_year
FROM t WHERE y IS NOT NULL""")
def repaired_years(spark, sf):
    rows = games(spark, sf).select("appid", X.repair_year(F.expr(_YEAR_TEXT)).alias("release_year"))
    return rows.where(F.col("release_year").isNotNull())


@query("imputed_years", "P16", "WITH " + GAMES + """,
t AS (SELECT appid, CAST(year(release_date) + CASE WHEN appid % 3 = 0 THEN 8 ELSE 0 END AS INT) AS y FROM games)
SELECT appid, CASE WHEN y < 2000 THEN (SELECT median(y) FROM t WHERE y > 2000) ELSE CAST(y AS DOUBLE) END AS release_year FROM t""")
def imputed_years(spark, sf):
    years = games(spark, sf).select(
        "appid", (F.year("release_date") + F.when(F.col("appid") % 3 == 0, 8).otherwise(0)).alias("release_year"))
    return split.impute_early_years(years, "release_year")


@query("renamed_preview", "P17 P18", "WITH " + GAMES + """
SELECT appid, name AS title, price AS list_price FROM games ORDER BY appid LIMIT 20""")
def renamed_preview(spark, sf):
    shown = reports.display_names(games(spark, sf).select("appid", "name", "price"), {"name": "title", "price": "list_price"})
    return reports.preview(shown, "appid", 20)


@query("owner_ranges", "P19 X5 X6", "WITH " + RAW + """,
t AS (SELECT appid, copy, replace(estimated_owners, ',', '') AS o FROM raw),
b AS (SELECT appid, copy, TRY_CAST(trim(split_part(o, '-', 1)) AS DOUBLE) AS lo, TRY_CAST(trim(split_part(o, '-', 2)) AS DOUBLE) AS hi FROM t)
SELECT appid, copy, lo AS owners_lower, GREATEST(COALESCE((lo + hi) / 2, 400.0), 400.0) AS owners_mid FROM b WHERE lo IS NOT NULL""")
def owner_ranges(spark, sf):
    ranged = raw_games(spark, sf).select(
        "appid", "copy", X.owners_lower("estimated_owners").alias("owners_lower"),
        X.owners_mid("estimated_owners", CFG.owners_mid_floor).alias("owners_mid"))
    return ranged.where(F.col("owners_lower").isNotNull())


# --- scalar functions ------------------------------------------------------

@query("logs", "X1", "WITH " + CLEAN + """
SELECT appid, round(ln(1 + price), 6) + 0.0 AS log_price, round(ln(1 + total_reviews_calc), 6) + 0.0 AS log_reviews FROM cleaned""")
def logs(spark, sf):
    return cleaned(spark, sf).select("appid", r6(F.log1p("price")).alias("log_price"),
                                     r6(F.log1p("total_reviews_calc")).alias("log_reviews"))


@query("calendar", "X2 X3 X4", "WITH " + GAMES + """
SELECT appid, CAST(year(release_date) AS INT) AS release_year, CAST(month(release_date) AS INT) AS release_month,
  CAST(isodow(release_date) - 1 AS INT) AS release_dow, round(sin(2 * pi() * month(release_date) / 12), 6) + 0.0 AS month_sin,
  round(cos(2 * pi() * month(release_date) / 12), 6) + 0.0 AS month_cos,
  CASE WHEN month(release_date) >= 10 THEN 1 ELSE 0 END AS is_q4_release FROM games""")
def calendar(spark, sf):
    made = X.calendar("release_date")
    rounded = {n: r6(c) if n.startswith("month_") else c for n, c in made.items()}
    return games(spark, sf).select("appid", *[c.alias(n) for n, c in rounded.items()])


@query("rating_bounds", "X7 X8", "WITH " + RAW + """,
t AS (SELECT appid, copy, positive, CAST(COALESCE(positive, 0) AS DOUBLE) AS p, CAST(COALESCE(positive, 0) + COALESCE(negative, 0) AS DOUBLE) AS n FROM raw)
SELECT appid, copy, CASE WHEN positive IS NULL OR n = 0 THEN 0.0 ELSE round(positive / n, 6) + 0.0 END AS positive_ratio,
  CASE WHEN n = 0 THEN 0.0 ELSE round((p / n + 1.9208 / n - 1.96 * sqrt(p / n * (1 - p / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) + 0.0 END AS wilson_lb
FROM t""")
def rating_bounds(spark, sf):
    rows = raw_games(spark, sf).withColumn("n", X.total_reviews("positive", "negative"))
    return rows.select("appid", "copy", r6(X.positive_ratio("positive", "n")).alias("positive_ratio"),
                       r6(X.wilson_lower_bound("positive", "n")).alias("wilson_lb"))


@query("parsed_lists", "X9 X10", "WITH " + RAW + f"""
SELECT appid, copy, {items('genres')} AS genre_list, {items('tags')} AS tag_list,
  CAST(len({items('tags')}) AS INT) AS n_tag,
  CASE WHEN categories IS NULL OR categories = 'nan' THEN 0 ELSE 2 END AS n_cat,
  CAST(len(COALESCE({items('supported_languages')}, [])) AS INT) AS n_languages FROM raw""")
def parsed_lists(spark, sf):
    return raw_games(spark, sf).select(
        "appid", "copy", X.parse_list("genres").alias("genre_list"), X.parse_list("tags").alias("tag_list"),
        F.size(X.parse_list("tags")).alias("n_tag"), F.size(X.parse_list("categories")).alias("n_cat"),
        F.size(X.parse_list("supported_languages")).alias("n_languages"))


@query("first_vendors", "X11", "WITH " + RAW + f""",
t AS (SELECT appid, copy, {items('developers')}[1] AS d, {items('publishers')}[1] AS p FROM raw)
SELECT appid, copy, COALESCE(d, 'unknown') AS developer, COALESCE(p, 'unknown') AS publisher,
  CASE WHEN COALESCE(d, '?') = COALESCE(p, '?') THEN 1 ELSE 0 END AS is_self_published FROM t""")
def first_vendors(spark, sf):
    dev, pub = X.parse_list("developers"), X.parse_list("publishers")
    return raw_games(spark, sf).select(
        "appid", "copy", X.first_or(dev, "unknown").alias("developer"), X.first_or(pub, "unknown").alias("publisher"),
        (X.first_or(dev, "?") == X.first_or(pub, "?")).cast("int").alias("is_self_published"))


@query("safe_names", "X12", """
SELECT p_partkey, substr(replace(replace(replace(lower(concat(p_name, ' / Co-op ', p_type, ' ', p_brand)), ' ', '_'), '-', '_'), '/', '_'), 1, 30) AS safe_name FROM part""")
def safe_names(spark, sf):
    text = F.concat("p_name", F.lit(" / Co-op "), "p_type", F.lit(" "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", X.safe_name(text).alias("safe_name"))


@query("price_and_platform", "X13", "WITH " + CLEAN + """
SELECT appid, CASE WHEN price = 0 THEN 1 ELSE 0 END AS is_free, CAST(windows AS INT) AS windows, CAST(mac AS INT) AS mac,
  CAST(linux AS INT) AS linux, CAST(windows AS INT) + CAST(mac AS INT) + CAST(linux AS INT) AS n_platforms FROM cleaned""")
def price_and_platform(spark, sf):
    made = features.price_and_platform()
    return cleaned(spark, sf).select("appid", *[c.alias(n) for n, c in made.items() if n != "log_price"])


@query("suffixed_labels", "X14", "WITH " + GAMES + """
SELECT appid, concat(CAST(year(release_date) AS VARCHAR), 'y') AS year_label,
  concat(CAST(CAST(required_age AS INT) AS VARCHAR), '+') AS age_label FROM games""")
def suffixed_labels(spark, sf):
    return games(spark, sf).select("appid", X.with_suffix(F.year("release_date"), "y").alias("year_label"),
                                   X.with_suffix(F.col("required_age").cast("int"), "+").alias("age_label"))


@query("query_shape", "X15", r"""
SELECT conv_id, turn, regexp_matches(text, '[가-힣]') AS has_hangul,
  CAST(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0
    ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS INT) AS words FROM conversations""")
def query_shape(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.has_hangul("text").alias("has_hangul"), X.word_count("text").alias("words"))
