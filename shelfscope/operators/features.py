"""Feature table: multi-hots, calendar, vendor counts, and the leakage guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.config import CatalogConfig
from shelfscope.functions import scalars as X
from shelfscope.operators.skew import add_lookup
from shelfscope.session import checkpointed

PLATFORMS = ("windows", "mac", "linux")

CATALOG_COLUMNS = (
    "appid", "name", "price", "genres", "windows", "mac", "linux", "positive_ratio",
    "wilson_lb", "owners_lower", "total_reviews_calc", "is_suspicious", "anomaly_score",
    "target_hidden_gem", "target_hit", "release_year",
)


def item_counts(df: DataFrame, lists: Mapping[str, Column]) -> DataFrame:
    """(kind, item, n) of several list columns in one pass. Repeats within a row count."""
    def tagged(kind: str, items: Column) -> Column:
        return F.transform(items, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("item")))

    every = F.concat(*[tagged(kind, items) for kind, items in lists.items()])
    return df.select(F.inline(every)).where(F.col("item").isNotNull()).groupBy("kind", "item").agg(
        F.count("*").alias("n"))


def top_items(counts: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """(kind, item, n, rank): the most frequent items of each kind; ties go to the smaller item."""
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), F.asc("item")))
    limits = F.create_map(*[F.lit(x) for kind_size in sizes.items() for x in kind_size])
    return (
        counts.where(F.col("kind").isin(*sizes)).withColumn("rank", rank)
        .where(F.col("rank") <= max(sizes.values()))
        .where(F.col("rank") <= limits[F.col("kind")])
    )


@dataclass(frozen=True)
class Vocabulary:
    """Items per kind, most frequent first. Its size is bounded by the top-n parameters."""

    items: dict[str, tuple[str, ...]]

    @classmethod
    def fit(cls, counts: DataFrame, sizes: Mapping[str, int]) -> "Vocabulary":
        found = top_items(counts, sizes).orderBy("kind", "rank").collect()
        return cls({k: tuple(r["item"] for r in found if r["kind"] == k) for k in sizes})

    def columns(self, kind: str, items: Column) -> dict[str, Column]:
        """0/1 columns; when two items share a safe name, the less frequent one wins."""
        hot = {f"{kind}_{X.safe_column(i)}": F.array_contains(items, i).cast("int")
               for i in self.items[kind]}
        return {**hot, f"n_{kind}": F.size(items)}


def multi_hot(df: DataFrame, source: str, kind: str, n: int) -> DataFrame:
    """Adds the multi-hot columns of one list-literal column."""
    parsed = df.withColumn("_items", X.parse_list(source))
    vocabulary = Vocabulary.fit(item_counts(parsed, {kind: F.col("_items")}), {kind: n})
    made = vocabulary.columns(kind, F.col("_items"))
    return parsed.select(*df.columns, *[c.alias(name) for name, c in made.items()])


def price_and_platform() -> dict[str, Column]:
    flags = {p: F.coalesce(F.col(p).cast("boolean"), F.lit(False)).cast("int") for p in PLATFORMS}
    return {
        "is_free": (F.col("price") == 0).cast("int"),
        "log_price": F.log1p("price"),
        **flags,
        "n_platforms": sum(list(flags.values())[1:], flags["windows"]),
    }


VENDORS = {"dev": "developers_game_count", "pub": "publishers_game_count"}


def first_vendors(developers: Column, publishers: Column) -> dict[str, Column]:
    return {"dev": X.first_or(developers, "unknown"), "pub": X.first_or(publishers, "unknown")}


def vendor_features(df: DataFrame, developers: Column, publishers: Column, counts: DataFrame | None = None,
                    key: str = "appid") -> DataFrame:
    """Games per first developer and per first publisher, and whether the two agree.

    ``counts`` are stored item counts that hold the kinds 'dev' and 'pub', if there are any yet.
    """
    vendors = first_vendors(developers, publishers)
    if counts is None:
        counts = checkpointed(item_counts(df, {k: F.array(c) for k, c in vendors.items()}))
    out = df.withColumns({
        "is_self_published": (X.first_or(developers, "?") == X.first_or(publishers, "?")).cast("int"),
        **{f"_{k}": c for k, c in vendors.items()},
    })
    for kind, name in VENDORS.items():
        out = add_lookup(out, counts.where(F.col("kind") == kind), f"_{kind}", key, name)
    return out.drop(*[f"_{k}" for k in vendors])


def _lists(df: DataFrame) -> dict[str, Column]:
    """List columns by the short kind their features carry."""
    found = {"genre": "genres", "tag": "tags", "cat": "categories",
             "lang": "supported_languages", "dev": "developers", "pub": "publishers"}
    return {k: X.parse_list(c) for k, c in found.items() if c in df.columns}


def engineer(df: DataFrame, cfg: CatalogConfig, vocabulary_from: DataFrame | None = None) -> DataFrame:
    """The full table: keys, intermediates, features and targets, before the leakage guard.

    One pass counts list items and vendors, and its small result is stored. Vocabularies
    come from all rows, or from ``vocabulary_from`` (for example the train rows).
    """
    lists = _lists(df)
    sizes = {k: n for k, n in (("genre", cfg.top_genres), ("tag", cfg.top_tags), ("cat", cfg.top_categories))
             if k in lists}
    hot = {k: lists[k] for k in sizes}
    vendors = first_vendors(lists["dev"], lists["pub"]) if {"dev", "pub"} <= set(lists) else {}
    counts = checkpointed(item_counts(df, {**hot, **{k: F.array(c) for k, c in vendors.items()}}))
    vocabulary = Vocabulary.fit(counts if vocabulary_from is None else item_counts(vocabulary_from, hot), sizes)

    parsed = df.select("*", *[c.alias(f"_l_{k}") for k, c in lists.items()])
    added: dict[str, Column] = {**price_and_platform(), **X.calendar("release_date")}
    for kind in sizes:
        added.update(vocabulary.columns(kind, F.col(f"_l_{kind}")))
    if "lang" in lists:
        added["n_languages"] = F.size("_l_lang")
    kept = [c for c in parsed.columns if c not in added]
    wide = parsed.select(*kept, *[c.alias(n) for n, c in added.items()])
    if vendors:
        wide = vendor_features(wide, F.col("_l_dev"), F.col("_l_pub"), counts)
    return wide.drop(*[f"_l_{k}" for k in lists])


def display_catalog(engineered: DataFrame) -> DataFrame:
    return engineered.select(*[c for c in CATALOG_COLUMNS if c in engineered.columns])


def leakage_guard(df: DataFrame, cfg: CatalogConfig, keep: Sequence[str] = ("appid",)) -> tuple[DataFrame, list[str]]:
    """Features, targets and text only; also says which leakage columns were present."""
    leaked = [c for c in cfg.leakage_columns if c in df.columns]
    gone = [c for c in (*leaked, *cfg.intermediate_columns) if c not in keep]
    return df.drop(*gone), leaked


def feature_columns(df: DataFrame, keys: Sequence[str] = ("appid", "short_description", "split", "task")) -> list[str]:
    return [c for c in df.columns if not c.startswith("target_") and c not in keys]


def columns_like(df: DataFrame, prefix: str | None = None, parts: Sequence[str] = (), first: int | None = None) -> list[str]:
    """Column names by prefix or by any contained part (case-blind), the first ones only if asked."""
    found = [c for c in df.columns
             if (prefix is not None and c.startswith(prefix)) or any(p in c.lower() for p in parts)]
    return found[:first]


def as_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
