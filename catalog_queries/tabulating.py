"""Joins, aggregates, windows, top-k reports, labels, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import (
    CFG, CLEAN, FEATURES, GAMES, LABELLED, RAW, cleaned, engineered, games, items, labelled, query, raw_games, stored_labels, table)
from catalog_queries.shaping import _folder, r6
from shelfscope.functions import scalars as X
from shelfscope.operators import anomaly, features, labels, quality, reports, skew, split
from shelfscope.operators.metrics import best_run
from shelfscope.session import checkpointed

PLATFORM_COLUMNS = ["windows", "mac", "linux", "n_platforms", "target_hit"]


# --- joins and windows -----------------------------------------------------

@query("features_with_target", "J1", "WITH " + FEATURES + """
SELECT appid, n_platforms, round(log_price, 6) + 0.0 AS log_price, target_hit FROM features""")
def features_with_target(spark, sf):
    rows = labelled(spark, sf)
    made = features.price_and_platform()
    x = rows.select("appid", made["n_platforms"].alias("n_platforms"), r6(made["log_price"]).alias("log_price"))
    return x.join(rows.select("appid", "target_hit"), "appid")


@query("vendor_counts", "J2 W1 X11", "WITH " + RAW + f""",
t AS (SELECT appid, copy, COALESCE({items('developers')}[1], 'unknown') AS d, COALESCE({items('publishers')}[1], 'unknown') AS p,
    CASE WHEN COALESCE({items('developers')}[1], '?') = COALESCE({items('publishers')}[1], '?') THEN 1 ELSE 0 END AS is_self_published FROM raw)
SELECT appid, copy, is_self_published, CAST(count(*) OVER (PARTITION BY d) AS BIGINT) AS developers_game_count,
  CAST(count(*) OVER (PARTITION BY p) AS BIGINT) AS publishers_game_count FROM t""")
def vendor_counts(spark, sf):
    rows = raw_games(spark, sf).select("appid", "copy", X.parse_list("developers").alias("d"), X.parse_list("publishers").alias("p"))
    return features.vendor_features(rows, F.col("d"), F.col("p")).drop("d", "p")


@query("class_draw_ranks", "W3", "WITH " + LABELLED + """
SELECT appid, target_hit, CAST(row_number() OVER (PARTITION BY target_hit ORDER BY md5(concat(appid, '|42'))) AS BIGINT) AS class_rank FROM labelled""")
def class_draw_ranks(spark, sf):
    rows = stored_labels(spark, sf).select("appid", "target_hit")
    return split.class_draw_rank(rows, "target_hit", "appid", CFG.seed)


# --- aggregates ------------------------------------------------------------

@query("key_figures", "A2", "WITH " + GAMES + """
SELECT count(*) AS games, round(COALESCE(avg(price) FILTER (price > 0), 0), 6) + 0.0 AS avg_price,
  CAST(count(*) FILTER (price = 0) AS BIGINT) AS free_games, CAST(count(*) FILTER (price <> 0) AS BIGINT) AS paid_games FROM games""")
def key_figures(spark, sf):
    rows = games(spark, sf).withColumn("is_free", (F.col("price") == 0).cast("int"))
    return reports.key_figures(rows).withColumn("avg_price", r6("avg_price"))


@query("key_figures_by_age", "A3", "WITH " + GAMES + """
SELECT count(*) AS games, round(avg(price), 6) + 0.0 AS avg_price, CAST(count(*) FILTER (price = 0) AS BIGINT) AS free_games,
  count(DISTINCT required_age) AS age_ratings FROM games""")
def key_figures_by_age(spark, sf):
    rows = games(spark, sf).withColumn("is_free", (F.col("price") == 0).cast("int"))
    return reports.key_figures_by_age(rows).withColumn("avg_price", r6("avg_price"))


def _genre_table(spark, sf):
    df = features.multi_hot(stored_labels(spark, sf), "genres", "genre", CFG.top_genres)
    df = df.withColumn("release_year", F.year("release_date"))
    return df, features.columns_like(df, prefix="genre_")


_GENRE_ROWS = LABELLED + f""",
hot AS (SELECT DISTINCT appid, CAST(year(release_date) AS INT) AS release_year, target_hit, 'genre_' || lower(g) AS genre
  FROM (SELECT appid, release_date, target_hit, unnest({items('genres')}) AS g FROM labelled))"""


@query("top_genre", "A4", "WITH " + _GENRE_ROWS + """
SELECT upper(substr(genre, 7, 1)) || substr(genre, 8) AS genre, count(*) AS games FROM hot GROUP BY hot.genre ORDER BY games DESC, hot.genre LIMIT 1""")
def top_genre(spark, sf):
    return reports.top_genre(*_genre_table(spark, sf))


@query("genre_ranking", "A5", "WITH " + _GENRE_ROWS + """
SELECT genre, count(*) AS games FROM hot GROUP BY genre ORDER BY games DESC, genre LIMIT 10""")
def genre_ranking(spark, sf):
    return reports.genre_ranking(*_genre_table(spark, sf), n=10)


@query("genre_ranking_of_year", "A5", "WITH " + _GENRE_ROWS + """
SELECT genre, count(*) AS games FROM hot WHERE release_year = 1999 GROUP BY genre ORDER BY games DESC, genre LIMIT 10""")
def genre_ranking_of_year(spark, sf):
    return reports.genre_ranking(*_genre_table(spark, sf), year=1999, n=10)


@query("genre_trend", "A6 X14", "WITH " + _GENRE_ROWS + """,
y AS (SELECT DISTINCT release_year FROM hot), g AS (SELECT DISTINCT genre FROM hot)
SELECT y.release_year, concat(y.release_year, 'y') AS year_label, g.genre, count(hot.appid) AS games
FROM y CROSS JOIN g LEFT JOIN hot ON hot.release_year = y.release_year AND hot.genre = g.genre GROUP BY ALL""")
def genre_trend(spark, sf):
    df, columns = _genre_table(spark, sf)
    return reports.genre_trend(df, columns, "y").unpivot(["release_year", "year_label"], columns, "genre", "games")


@query("price_by_age", "A7", "WITH " + CLEAN + """
SELECT CAST(required_age AS INT) AS required_age, concat(CAST(required_age AS INT), '+') AS age_label,
  round(avg(price), 6) + 0.0 AS avg_price FROM cleaned GROUP BY ALL""")
def price_by_age(spark, sf):
    return reports.price_by_age(cleaned(spark, sf), "+").withColumn("avg_price", r6("avg_price"))


@query("genre_supply_demand", "A8 T6", "WITH " + LABELLED + f""",
g AS (SELECT unnest({items('genres')}) AS genre, owners_lower, total_reviews_calc FROM labelled)
SELECT genre, count(*) AS games, sum(owners_lower) AS owners, CAST(sum(total_reviews_calc) AS BIGINT) AS reviews,
  round(sum(owners_lower) / count(*), 6) + 0.0 AS owners_per_game FROM g GROUP BY genre ORDER BY games DESC, genre LIMIT 12""")
def genre_supply_demand(spark, sf):
    return reports.genre_supply_demand(labelled(spark, sf)).withColumn("owners_per_game", r6("owners_per_game"))


@query("top_tags", "A9", "WITH " + GAMES + f""",
t AS (SELECT unnest({items('tags')}) AS item FROM games)
SELECT 'tag' AS kind, item, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, item) AS INT) AS rank
FROM t GROUP BY item ORDER BY rank LIMIT 30""")
def top_tags(spark, sf):
    counts = features.item_counts(games(spark, sf), {"tag": X.parse_list("tags")})
    return features.top_items(counts, {"tag": CFG.top_tags})


@query("class_balance", "A10", "WITH " + LABELLED + """
SELECT 'hit' AS task, CAST(sum(target_hit) AS BIGINT) AS positives, CAST(sum(1 - target_hit) AS BIGINT) AS negatives,
  round(avg(target_hit), 6) + 0.0 AS positive_rate, round(sum(1 - target_hit) / sum(target_hit), 6) + 0.0 AS imbalance FROM labelled
UNION ALL SELECT 'hidden_gem', CAST(sum(target_hidden_gem) AS BIGINT), CAST(sum(1 - target_hidden_gem) AS BIGINT),
  round(avg(target_hidden_gem), 6) + 0.0, round(sum(1 - target_hidden_gem) / sum(target_hidden_gem), 6) + 0.0 FROM labelled""")
def class_balance(spark, sf):
    rows = labelled(spark, sf)
    parts = [labels.class_balance(rows, f"target_{t}").select(
        F.lit(t).alias("task"), "positives", "negatives", r6("positive_rate").alias("positive_rate"), r6("imbalance").alias("imbalance"))
        for t in ("hit", "hidden_gem")]
    return parts[0].unionByName(parts[1])


@query("class_counts", "A10", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def class_counts(spark, sf):
    return labels.class_counts(table(spark, sf, "labels"), "quality")


@query("label_summary", "F1 A10", "WITH " + LABELLED + """
SELECT count(*) AS rows, round(avg(target_hit), 6) + 0.0 AS hit_rate, round(avg(target_hidden_gem), 6) + 0.0 AS gem_rate,
  CAST(0 AS BIGINT) AS gems_excluded FROM labelled""")
def label_summary(spark, sf):
    return labels.label_summary(labelled(spark, sf), CFG).withColumns({"hit_rate": r6("hit_rate"), "gem_rate": r6("gem_rate")})


def _platforms(spark, sf):
    return labelled(spark, sf).select("target_hit", *[c.alias(n) for n, c in features.price_and_platform().items()])


@query("platform_correlations", "A11", "WITH " + FEATURES + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) + 0.0 AS r FROM features"
    for a in PLATFORM_COLUMNS for b in PLATFORM_COLUMNS) + ") SELECT * FROM c")
def platform_correlations(spark, sf):
    return reports.correlations(_platforms(spark, sf), PLATFORM_COLUMNS).withColumn("r", r6("r"))


@query("hit_genre_shares", "A12", "WITH " + _GENRE_ROWS + """,
g AS (SELECT DISTINCT genre FROM hot)
SELECT g.genre AS feature, round((SELECT count(*) FROM hot WHERE hot.genre = g.genre AND target_hit = 1)
  / (SELECT sum(target_hit) FROM labelled), 6) + 0.0 AS mean FROM g""")
def hit_genre_shares(spark, sf):
    df, columns = _genre_table(spark, sf)
    return reports.rescaled_means(df, columns, "target_hit").withColumn("mean", r6("mean"))


@query("rescaled_means", "A12", "WITH " + FEATURES + ", s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round((avg({c}) FILTER (target_hit = 1) - min({c})) / (max({c}) - min({c})), 6) + 0.0 AS mean FROM features"
    for c in ("price", "log_price", "required_age", "n_platforms", "total_reviews_calc")) + ") SELECT * FROM s")
def rescaled_means(spark, sf):
    rows = labelled(spark, sf).withColumns({k: v for k, v in features.price_and_platform().items() if k in ("log_price", "n_platforms")})
    columns = ["price", "log_price", "required_age", "n_platforms", "total_reviews_calc"]
    return reports.rescaled_means(rows, columns, "target_hit").withColumn("mean", r6("mean"))


def _histogram_sql(value: str, bins: int) -> str:
    return "WITH " + CLEAN + f""",
v AS (SELECT {value} AS x FROM cleaned), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM v),
b AS (SELECT LEAST(CAST(floor((x - lo) / w) AS INT), {bins - 1}) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * w, 6) + 0.0 AS low, round(lo + (g.bin + 1) * w, 6) + 0.0 AS high,
  COALESCE(n, 0) AS n FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN e LEFT JOIN b ON b.bin = g.bin"""


def _histogram(rows, value, bins):
    return reports.histogram(rows, value, bins).withColumns({"low": r6("low"), "high": r6("high")})


@query("price_histogram", "A13", _histogram_sql("price", 50))
def price_histogram(spark, sf):
    return _histogram(cleaned(spark, sf), "price", 50)


@query("log_price_histogram", "A13", _histogram_sql("ln(1 + price)", 30))
def log_price_histogram(spark, sf):
    return _histogram(cleaned(spark, sf).withColumn("log_price", F.log1p("price")), "log_price", 30)


@query("price_density", "A14", "WITH " + CLEAN + """,
s AS (SELECT stddev_samp(price) * pow(count(*), -0.2) AS w, min(price) AS lo, max(price) AS hi FROM cleaned),
v AS (SELECT price AS x, count(*) AS c FROM cleaned GROUP BY 1),
g AS (SELECT CAST(unnest(range(200)) AS INT) AS point)
SELECT point, round(any_value(lo + point * ((hi - lo) / 199)), 6) + 0.0 AS x,
  round(sum(exp(-0.5 * pow((lo + point * ((hi - lo) / 199) - v.x) / w, 2)) * c) * any_value((hi - lo) / 30 / (w * sqrt(2 * pi()))), 4) + 0.0 AS y
FROM g, s, v GROUP BY point""")
def price_density(spark, sf):
    made = reports.density(cleaned(spark, sf), "price", 30, 200)
    return made.select("point", r6("x").alias("x"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query("capped_reviews_per_owner", "A15 X6 F2", "WITH " + CLEAN + """,
t AS (SELECT appid, total_reviews_calc / GREATEST((CAST(split_part(estimated_owners, ' - ', 1) AS DOUBLE)
    + CAST(split_part(estimated_owners, ' - ', 2) AS DOUBLE)) / 2, 400.0) AS r FROM cleaned)
SELECT appid, round(LEAST(r, (SELECT quantile_cont(r, 0.999) FROM t)), 9) + 0.0 AS rev_per_owner FROM t""")
def capped_reviews_per_owner(spark, sf):
    rows = cleaned(spark, sf)
    capped = anomaly.signal_columns(CFG, anomaly.per_owner_cap(rows, CFG))["rev_per_owner"]
    return rows.select("appid", (F.round(capped, 9) + F.lit(0.0)).alias("rev_per_owner"))


QUANTILES = (0.001, 0.5, 0.98, 0.999)


@query("exact_quantiles", "A15", " UNION ALL ".join(f"""
SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(l_extendedprice, {q}), 6) + 0.0 AS price,
  round(quantile_cont(l_quantity, {q}), 6) + 0.0 AS quantity FROM lineitem""" for q in QUANTILES))
def exact_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem")
    made = list(zip(QUANTILES, skew.exact_quantiles(rows, "l_extendedprice", QUANTILES),
                    skew.exact_quantiles(rows, "l_quantity", QUANTILES)))
    return spark.createDataFrame(made, "q double, price double, quantity double").withColumns(
        {"price": r6("price"), "quantity": r6("quantity")})


_PRINTED = ("appid price required_age windows mac linux is_free log_price n_platforms n_genre n_tag release_year release_month release_dow "
            "month_sin month_cos is_q4_release developers_game_count publishers_game_count is_self_published").split()


_FINGERPRINT_SQL = "WITH " + FEATURES + f""",
g AS (SELECT appid, 'genre' AS kind, unnest({items('genres')}) AS item FROM features
  UNION ALL SELECT appid, 'tag', unnest({items('tags')}) FROM features),
voc AS (SELECT kind, item FROM (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, item) AS r FROM g GROUP BY 1, 2)
  WHERE r <= CASE kind WHEN 'genre' THEN 15 ELSE 30 END),
hot AS (SELECT appid, string_agg(name, ',' ORDER BY name) AS hot FROM (SELECT DISTINCT appid,
    concat(kind, '_', replace(replace(replace(lower(item), ' ', '_'), '-', '_'), '/', '_')) AS name FROM g JOIN voc USING (kind, item)) GROUP BY appid),
v AS (SELECT list_append([""" + ", ".join(f"CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)" for c in _PRINTED) + """], COALESCE(hot, '')) AS a
  FROM features LEFT JOIN hot USING (appid)),
h AS (SELECT md5(array_to_string(list_transform(a, lambda x: COALESCE(length(x) || ':' || x, '~')), '|')) AS m FROM v)
SELECT substr(sha256(concat(count(*), ':', sum(CAST(('0x' || substr(m, 1, 15)) AS HUGEINT)))), 1, 12) AS data_hash FROM h"""


def _printed(rows):
    """Values in millionths, so that both engines write them alike, and the names of the set multi-hots."""
    hot = sorted(features.columns_like(rows, prefix="genre_") + features.columns_like(rows, prefix="tag_"))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in hot])), ",")
    return {c: F.round(F.col(c) * 1_000_000).cast("long") for c in _PRINTED} | {"hot": names}


@query("content_fingerprint", "A19 F4", _FINGERPRINT_SQL)
def content_fingerprint(spark, sf):
    """The whole feature table."""
    rows = engineered(spark, sf)
    return quality.fingerprint(rows, _printed(rows))


@query("stored_fingerprint", "A19 F4", _FINGERPRINT_SQL)
def stored_fingerprint(spark, sf):
    """The same from stored parts by year, written in two steps, the second of which reads the later years alone."""
    rows, path = engineered(spark, sf), _folder(spark, sf, "fingerprints")
    for years in (F.col("release_year") < 1999, F.coalesce(F.col("release_year") >= 1999, F.lit(True))):
        quality.fingerprint_parts(rows.where(years), _printed(rows), "release_year").write.mode("append").parquet(path)
    return quality.merged_fingerprint(spark.read.parquet(path))


@query("sample_names", "A20", "WITH " + GAMES + """
SELECT string_agg(name, ' · ' ORDER BY appid) AS sample_names FROM (SELECT appid, name FROM games WHERE price > 0 ORDER BY appid LIMIT 5)""")
def sample_names(spark, sf):
    return reports.sample_names(reports.view(games(spark, sf).withColumn("is_free", (F.col("price") == 0).cast("int")), "paid"))


# --- labels, features, splits ----------------------------------------------

@query("labels", "F1 X5 X7 X8 P19", "WITH " + LABELLED + """
SELECT appid, owners_lower, round(positive_ratio, 6) + 0.0 AS positive_ratio, round(wilson_lb, 6) + 0.0 AS wilson_lb,
  target_hit, target_hidden_gem FROM labelled""")
def labels_query(spark, sf):
    return labelled(spark, sf).select(
        "appid", "owners_lower", r6("positive_ratio").alias("positive_ratio"), r6("wilson_lb").alias("wilson_lb"),
        "target_hit", "target_hidden_gem")


@query("anomaly_signals", "F2 A15", "WITH " + CLEAN + """,
t AS (SELECT *, total_reviews_calc / GREATEST((CAST(split_part(estimated_owners, ' - ', 1) AS DOUBLE)
    + CAST(split_part(estimated_owners, ' - ', 2) AS DOUBLE)) / 2, 400.0) AS r FROM cleaned)
SELECT appid, round(ln(1 + total_reviews_calc), 6) + 0.0 AS log_reviews,
  round(LEAST(r, (SELECT quantile_cont(r, 0.999) FROM t)), 6) + 0.0 AS rev_per_owner,
  round(positive / total_reviews_calc, 6) + 0.0 AS positive_ratio,
  round(LEAST(recommendations / total_reviews_calc, 10), 6) + 0.0 AS rec_per_review, round(ln(1 + price), 6) + 0.0 AS log_price FROM t""")
def anomaly_signals(spark, sf):
    made = anomaly.anomaly_signals(cleaned(spark, sf), CFG)
    return made.select("appid", *[r6(c).alias(c) for c in anomaly.SIGNALS])


@query("multi_hot_long", "F4 X10 X12", "WITH " + LABELLED + f""",
g AS (SELECT appid, 'genre' AS kind, unnest({items('genres')}) AS item FROM labelled
  UNION ALL SELECT appid, 'tag', unnest({items('tags')}) FROM labelled),
voc AS (SELECT kind, item FROM (SELECT kind, item, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, item) AS r FROM g GROUP BY 1, 2)
  WHERE r <= CASE kind WHEN 'genre' THEN 15 ELSE 30 END)
SELECT l.appid, concat(v.kind, '_', replace(replace(replace(lower(v.item), ' ', '_'), '-', '_'), '/', '_')) AS feature,
  CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.appid = l.appid AND g.kind = v.kind AND g.item = v.item) THEN 1 ELSE 0 END AS value
FROM labelled l, voc v""")
def multi_hot_long(spark, sf):
    df = features.multi_hot(stored_labels(spark, sf), "genres", "genre", CFG.top_genres)
    df = features.multi_hot(df, "tags", "tag", CFG.top_tags)
    hot = features.columns_like(df, prefix="genre_") + features.columns_like(df, prefix="tag_")
    return df.unpivot("appid", hot, "feature", "value")


_FEATURE_COLUMNS = """price, required_age, windows, mac, linux, is_free, round(log_price, 6) + 0.0 AS log_price, n_platforms, n_genre, n_tag,
  release_year, release_month, release_dow, round(month_sin, 6) + 0.0 AS month_sin, round(month_cos, 6) + 0.0 AS month_cos, is_q4_release,
  developers_game_count, publishers_game_count, is_self_published, target_hit, target_hidden_gem"""


@query("feature_table", "F5 X1 X2 X3 X4 X13 W1 P1", "WITH " + FEATURES + f""",
t AS (SELECT appid, unnest({items('tags')}) AS item FROM features),
voc AS (SELECT item FROM t GROUP BY item ORDER BY count(*) DESC, item LIMIT 30),
h AS (SELECT appid, CAST(2 + count(voc.item) AS INT) AS hot FROM t LEFT JOIN voc ON t.item = voc.item GROUP BY appid)
SELECT appid, {_FEATURE_COLUMNS}, hot FROM features JOIN h USING (appid)""")
def feature_table(spark, sf):
    guarded, _ = features.leakage_guard(engineered(spark, sf), CFG)
    hot = features.columns_like(guarded, prefix="genre_") + features.columns_like(guarded, prefix="tag_")
    made = guarded.withColumn("hot", sum([F.col(c) for c in hot], F.lit(0))).drop("short_description", *hot)
    return made.withColumns({c: r6(c) for c in ("log_price", "month_sin", "month_cos")})


@query("display_catalog", "F5 S4", "WITH " + FEATURES + """
SELECT appid, name, price, genres, windows, mac, linux, round(positive_ratio, 6) + 0.0 AS positive_ratio, round(wilson_lb, 6) + 0.0 AS wilson_lb,
  owners_lower, total_reviews_calc, target_hidden_gem, target_hit, release_year FROM features""")
def display_catalog(spark, sf):
    made = features.display_catalog(engineered(spark, sf))
    return made.withColumns({c: r6(c) for c in ("positive_ratio", "wilson_lb")})


_SPLIT = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY {t} ORDER BY md5(concat(appid, '|42'))) AS rk, count(*) OVER (PARTITION BY {t}) AS n FROM {f}),
parts AS (SELECT *, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM ranked)"""


def _split_sql(task: str, source: str = "labelled") -> str:
    return _SPLIT.format(t=f"target_{task}", f=source)


for _task in ("hit", "hidden_gem"):
    @query(f"split_{_task}", "F6 W3", "WITH " + LABELLED + _split_sql(_task) + f"""
SELECT appid, target_{_task}, split FROM parts""")
    def _split(spark, sf, task=_task):
        rows = stored_labels(spark, sf).select("appid", f"target_{task}")
        return split.stratified_split(rows, f"target_{task}", "appid", CFG.test_size, CFG.seed)


_SCALED = ["price", "required_age", "log_price", "n_platforms", "is_free", "release_year", "developers_game_count"]


@query("scaled_features", "F7 P3", "WITH " + FEATURES + _split_sql("hidden_gem", "features") + """
SELECT appid, split, """ + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM parts WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM parts WHERE split = 'train'), 5) + 0.0 AS {c}"
    for c in _SCALED) + " FROM parts")
def scaled_features(spark, sf):
    rows = checkpointed(engineered(spark, sf).select("appid", "target_hidden_gem", *_SCALED))
    parts = split.stratified_split(rows, "target_hidden_gem", "appid", CFG.test_size, CFG.seed)
    scaler = split.Scaler.fit(parts.where("split = 'train'"), _SCALED)
    return scaler.transform(parts).select("appid", "split", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in _SCALED])


_BALANCED = """,
balanced AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_hit ORDER BY md5(concat(appid, '|42'))) AS rk FROM labelled)
  WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY target_hit)))"""


@query("downsampled", "F16", "WITH " + LABELLED + _BALANCED + " SELECT appid, target_hit FROM balanced")
def downsampled(spark, sf):
    return split.downsample(stored_labels(spark, sf).select("appid", "target_hit"), "target_hit", "appid", CFG.seed)


@query("class_union", "U1 F16", "WITH " + LABELLED + _BALANCED + " SELECT appid, target_hit, price FROM balanced")
def class_union(spark, sf):
    rows = stored_labels(spark, sf).select("appid", "target_hit", "price")
    kept = split.downsample(rows, "target_hit", "appid", CFG.seed)
    return kept.where("target_hit = 0").unionByName(rows.where("target_hit = 1"))


@query("validation_split", "F18", "WITH " + LABELLED + _BALANCED + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_hit ORDER BY md5(concat(appid, '|7'))) AS r2, count(*) OVER (PARTITION BY target_hit) AS n FROM balanced)
SELECT appid, target_hit, CASE WHEN r2 <= round(n * 0.2) THEN 'valid' ELSE 'train' END AS split FROM ranked""")
def validation_split(spark, sf):
    kept = split.downsample(stored_labels(spark, sf).select("appid", "target_hit"), "target_hit", "appid", CFG.seed)
    return split.stratified_split(kept, "target_hit", "appid", 0.2, 7, ("train", "valid"))


# --- top-k reports ---------------------------------------------------------

def confirmed_gems(spark, sf):
    facets = reports.catalog_facets(60, ["windows"], [])
    top = reports.confirmed_gems(labelled(spark, sf), facets, 20)
    return top.select("appid", "name", "price", r6("positive_ratio").alias("positive_ratio"),
                      r6("wilson_lb").alias("wilson_lb"), "total_reviews_calc",
                      F.year("release_date").alias("release_year"))


query("confirmed_gems", "T1 P11", "WITH " + LABELLED + """
SELECT appid, name, price, round(positive_ratio, 6) + 0.0 AS positive_ratio, round(wilson_lb, 6) + 0.0 AS wilson_lb, total_reviews_calc,
  CAST(year(release_date) AS INT) AS release_year FROM labelled
WHERE target_hidden_gem = 1 AND price <= 60 AND windows ORDER BY labelled.wilson_lb DESC, appid LIMIT 20""")(confirmed_gems)


@query("best_runs", "T7", """
SELECT task, run_id, round(pr_auc, 6) + 0.0 AS pr_auc FROM (
  SELECT l_returnflag AS task, l_shipmonth AS run_id, avg(l_discount) AS pr_auc FROM
    (SELECT *, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS l_shipmonth FROM lineitem) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY task ORDER BY pr_auc DESC, run_id) = 1""")
def best_runs(spark, sf):
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task"), month.alias("run_id")).agg(
        F.avg("l_discount").alias("pr_auc"))
    return best_run(runs, "pr_auc").withColumn("pr_auc", r6("pr_auc"))
