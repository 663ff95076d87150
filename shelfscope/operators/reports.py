"""Market reports over catalog and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions import scalars as X

VIEWS = ("all", "free", "paid", "genre", "new")


# --- filters ---------------------------------------------------------------

def view(df: DataFrame, name: str = "all") -> DataFrame:
    """The rows of a named view; 'genre' shows all rows, 'new' the latest release year."""
    if name == "free":
        return df.where(F.col("is_free") == 1)
    if name == "paid":
        return df.where(F.col("is_free") == 0)
    if name == "new":
        latest = df.agg(F.max("release_year").alias("release_year"))
        return df.join(F.broadcast(latest), "release_year", "left_semi")
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; use one of {VIEWS}")
    return df


def in_views(df: DataFrame) -> DataFrame:
    """The rows of all named views, told apart by ``view``. One scan: each row is repeated for the views that show it."""
    latest = df.agg(F.max("release_year").alias("_latest"))
    free, new = F.col("is_free"), F.col("release_year") == F.col("_latest")
    shown = {"all": F.lit(True), "free": free == 1, "paid": free == 0, "genre": F.lit(True), "new": new}
    names = F.array_compact(F.array(*[F.when(shown[v], F.lit(v)) for v in VIEWS]))
    return df.join(F.broadcast(latest)).select(*df.columns, F.explode(names).alias("view"))


def catalog_facets(max_price: float, platforms: Sequence[str] = (), genres: Sequence[str] = ()) -> Column:
    """Price, all platforms, and any genre as a part of the raw list text."""
    keep = F.col("price") <= max_price
    for p in platforms:
        keep = keep & (F.col(p).cast("int") == 1)
    if genres:
        held = F.lit(False)
        for g in genres:
            held = held | F.col("genres").contains(g)
        keep = keep & F.coalesce(held, F.lit(False))
    return keep


def find_by_name(df: DataFrame, pattern: str, n: int = 20, key: str = "appid") -> DataFrame:
    """Names that match a case-blind regular expression, the first n by key."""
    return preview(df.where(F.col("name").rlike("(?i)" + pattern)), key, n)


def preview(df: DataFrame, key: str = "appid", n: int = 20) -> DataFrame:
    return df.orderBy(key).limit(n)


def display_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


# --- key figures -----------------------------------------------------------

def key_figures(df: DataFrame) -> DataFrame:
    """Rows, mean price of priced rows, free and paid counts."""
    free = F.coalesce(F.sum(F.col("is_free").cast("long")), F.lit(0))
    return df.agg(
        F.count("*").alias("games"),
        F.coalesce(F.avg(F.when(F.col("price") > 0, F.col("price"))), F.lit(0.0)).alias("avg_price"),
        free.alias("free_games"),
        (F.count("*") - free).alias("paid_games"),
    )


def key_figures_by_age(df: DataFrame) -> DataFrame:
    """Rows, mean price over all rows, free count and distinct age ratings."""
    return df.agg(
        F.count("*").alias("games"),
        F.avg("price").alias("avg_price"),
        F.coalesce(F.sum(F.col("is_free").cast("long")), F.lit(0)).alias("free_games"),
        F.count_distinct("required_age").alias("age_ratings"),
    )


def sample_names(df: DataFrame, n: int = 5, key: str = "appid", separator: str = " · ") -> DataFrame:
    first = preview(df.where(F.col("name").isNotNull()).select(key, "name"), key, n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("name"))))
    return first.agg(F.array_join(F.transform(ordered, lambda s: s["name"]), separator).alias("sample_names"))


# --- genres ----------------------------------------------------------------

def genre_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(genre, games) from multi-hot columns: one aggregate, then one row per column."""
    pairs = [F.struct(F.lit(c).alias("genre"),
                      F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias("games")) for c in columns]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def genre_label(c: Column | str) -> Column:
    return F.initcap(F.translate(F.regexp_replace(X.col(c), "^genre_", ""), "_", " "))


def top_genre(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    best = genre_totals(df, columns).orderBy(F.desc("games"), "genre").limit(1)
    return best.select(genre_label("genre").alias("genre"), "games")


def genre_ranking(df: DataFrame, columns: Sequence[str], year: int | None = None, n: int = 10) -> DataFrame:
    rows = df if year is None else df.where(F.col("release_year") == year)
    return genre_totals(rows, columns).orderBy(F.desc("games"), "genre").limit(n)


def genre_trend(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Games of each genre column per release year."""
    sums = df.groupBy("release_year").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in columns])
    return sums.withColumn("year_label", X.with_suffix("release_year", suffix))


def genre_supply_demand(catalog: DataFrame, n: int = 12) -> DataFrame:
    """Games, owners, reviews and owners per game of the genres with the most games."""
    rows = catalog.select(F.explode(X.parse_list("genres")).alias("genre"), "owners_lower", "total_reviews_calc")
    return (
        rows.groupBy("genre").agg(
            F.count("*").alias("games"), F.sum("owners_lower").alias("owners"),
            F.sum("total_reviews_calc").alias("reviews"))
        .withColumn("owners_per_game", F.col("owners") / F.col("games"))
        .orderBy(F.desc("games"), "genre").limit(n)
    )


# --- prices and distributions ----------------------------------------------

def price_by_age(df: DataFrame, suffix: str = "") -> DataFrame:
    rows = df.where(F.col("required_age").isNotNull() & F.col("price").isNotNull())
    return (
        rows.groupBy(F.col("required_age").cast("int").alias("required_age")).agg(F.avg("price").alias("avg_price"))
        .withColumn("age_label", X.with_suffix("required_age", suffix)).orderBy("required_age")
    )


def _range(df: DataFrame, value: str) -> tuple[float, float] | None:
    row = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n) over equal widths; the maximum belongs to the last bin and empty
    bins are kept."""
    ends = _range(df, value)
    if ends is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, high = ends
    width = (high - low) / bins or 1.0 / bins
    place = F.least(F.floor((F.col(value).cast("double") - low) / width).cast("int"), F.lit(bins - 1))
    counts = df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


#: The kernel runs over every distinct value; tests allow for the error of a grid this many times finer than the one asked for.
FINE = 8


def density(df: DataFrame, value: str, bins: int, grid: int = 200) -> DataFrame:
    """(point, x, y): Gaussian density on an even grid, scaled to the counts of ``bins`` bins.

    Scott's bandwidth. Rows are first counted per distinct value; each value then adds to every
    grid point inside its own task, so only grid-sized sums are shuffled.
    """
    x = F.col(value).cast("double")
    stats = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not stats["n"] or not stats["s"]:
        return df.sparkSession.createDataFrame([], "point int, x double, y double")
    width = stats["s"] * stats["n"] ** -0.2
    low, step = stats["lo"], (stats["hi"] - stats["lo"]) / (grid - 1)
    scale = (stats["hi"] - stats["lo"]) / bins / (width * (2 * 3.141592653589793) ** 0.5)
    at = F.lit(low) + F.col("point") * F.lit(step)
    away = (at - F.col("v")) / F.lit(width)
    values = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("c"))
    points = values.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    return points.groupBy("point").agg((F.sum(F.exp(-0.5 * away * away) * F.col("c")) * F.lit(scale)).alias("y")).select(
        "point", at.alias("x"), "y")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, r): Pearson correlation of every pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    stats = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.col(f"r{i}").alias("r")))
    return stats.select(F.inline(F.array(*cells)))


def rescaled_means(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, mean): each column rescaled to 0..1 and averaged over the positives.

    Rescaling is linear, so one aggregate of minimum, maximum and the positives' mean is enough.
    """
    stats = []
    for i, c in enumerate(columns):
        stats += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                  F.avg(F.when(F.col(label) == 1, F.col(c))).alias(f"m{i}")]
    row = df.agg(*stats)

    def cell(i: int, c: str):
        low, high, mean = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"m{i}")
        scaled = F.when(high != low, (mean - low) / (high - low)).when(mean.isNotNull(), F.lit(0.0))
        return F.struct(F.lit(c).alias("feature"), scaled.cast("double").alias("mean"))
    cells = row.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))
    return cells.orderBy(F.desc("mean"), "feature")


# --- recommendations -------------------------------------------------------

def confirmed_gems(catalog: DataFrame, facets: Column, n: int = 20) -> DataFrame:
    rows = catalog.where(facets & (F.col("target_hidden_gem") == 1))
    return rows.orderBy(F.desc("wilson_lb"), "appid").limit(n)


def latent_gems(scored: DataFrame, facets: Column, max_reviews: int = 30, n: int = 20) -> DataFrame:
    """Unlabelled rows with few reviews that the model scores highest."""
    rows = scored.where(facets & (F.col("target_hidden_gem") == 0) & (F.col("total_reviews_calc") < max_reviews))
    return rows.orderBy(F.desc("gem_score"), "appid").limit(n)


def suspicious(catalog: DataFrame, n: int = 20) -> DataFrame:
    return catalog.where(F.col("is_suspicious") == 1).orderBy(F.desc("anomaly_score"), "appid").limit(n)
