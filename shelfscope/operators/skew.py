"""Joins, prefix sums, quantiles and seeded picks that no hot key or global sort can stall."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.session import checkpointed

HOT_KEYS = 1000
LOOKUP_ROWS = 500_000


def within(df: DataFrame, rows: int) -> bool:
    """True if the table has at most ``rows`` rows; stops counting just above."""
    return df.limit(rows + 1).count() <= rows


def add_lookup(df: DataFrame, lookup: DataFrame, key: str, row_id: str, out: str) -> DataFrame:
    """Every row with the number ``n`` that ``lookup`` (item, n) holds for its ``key``.

    A lookup of at most ``LOOKUP_ROWS`` rows, as counted here, is broadcast. A larger one
    joins by shuffle, but its ``HOT_KEYS`` largest entries still go by broadcast, and rows
    with those keys shuffle under a key of their own, so they spread evenly and match
    nothing. ``lookup`` is read more than once and should be a stored table.
    """
    lookup = lookup.select("item", "n")
    if within(lookup, LOOKUP_ROWS):
        named = lookup.select(F.col("item").alias(key), F.col("n").alias(out))
        return df.join(F.broadcast(named), key, "left").select(*df.columns, out)
    hot = lookup.orderBy(F.desc("n"), F.asc("item")).limit(HOT_KEYS).select(
        F.col("item").alias(key), F.col("n").alias("_hot"))
    own = F.struct(F.lit(1).alias("own"), F.col(row_id).cast("string").alias("v"))
    shared = F.struct(F.lit(0).alias("own"), F.col(key).cast("string").alias("v"))
    marked = df.join(F.broadcast(hot), key, "left").withColumn(
        "_k", F.when(F.col("_hot").isNull(), shared).otherwise(own))
    cold = lookup.select(
        F.struct(F.lit(0).alias("own"), F.col("item").cast("string").alias("v")).alias("_k"), F.col("n").alias("_n"))
    return marked.join(cold, "_k", "left").select(*df.columns, F.coalesce("_hot", "_n").alias(out))


def _bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the half-open interval of sorted ``bounds`` that holds the value."""
    edges = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    return F.size(F.filter(edges, lambda e: e < value))


def cut_points(df: DataFrame, value: str, parts: int) -> list[float]:
    """At most ``parts - 1`` values that cut the column into similar shares.

    They only balance the work: any cut points give the same result downstream.
    """
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10_000).alias("p")).first()
    return sorted(set(row["p"] or []))


def _null_safe(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys where null meets null; the columns of ``rows`` and the other columns of ``offsets``."""
    others = [c for c in offsets.columns if c not in keys]
    right = offsets.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *others)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(right, same).select(*rows.columns, *others)


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (),
                   parts: int | None = None) -> DataFrame:
    """Inclusive running sums from the highest ``order`` value down, as ``cum_<name>``,
    with each group's whole sum as ``all_<name>``.

    The order column is cut into value ranges. Ranges are summed, their few totals are
    accumulated, and each range then runs its own window from its offset. Rows must be
    unique per (by, order).
    """
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = cut_points(df, order, parts)
    rows = df.withColumn("_b", _bucket(F.col(order).cast("double"), bounds))
    group = W.partitionBy(*by)
    above = group.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select(*by, "_b",
                *[F.coalesce(F.sum(f"_t_{c}").over(above), F.lit(0)).alias(f"_o_{c}") for c in sums],
                *[F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in sums])
    )
    inside = W.partitionBy(*by, "_b").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return _null_safe(rows, offsets, [*by, "_b"]).select(
        *df.columns, *[f"all_{c}" for c in sums], *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], accuracy: int = 100_000) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, for several shares at once.

    A sketch gives a narrow bracket around each wanted rank. One more pass counts the rows
    outside the brackets by gap, and keeps values apart only inside them.
    """
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull())
    slack = 4.0 / accuracy
    while True:
        ends = [(max(0.0, q - slack), min(1.0, q + slack)) for q in shares]
        head = rows.agg(
            F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
            F.percentile_approx("x", [e for pair in ends for e in pair], accuracy).alias("p")).first()
        if head["n"] == 0:
            return [None] * len(shares)
        brackets = [(head["lo"] if a <= 0 else head["p"][2 * i], head["hi"] if b >= 1 else head["p"][2 * i + 1])
                    for i, (a, b) in enumerate(ends)]
        apart, gap = F.lit(False), F.lit(0)
        for low, high in brackets:
            apart = apart | F.col("x").between(low, high)
            gap = gap + (F.col("x") > high).cast("int")
        # values inside a bracket may be many, so they are accumulated by ranges, not in one window
        groups = checkpointed(rows.groupBy(F.when(apart, F.col("x")).alias("v"), F.when(~apart, gap).alias("gap")).agg(
            F.count("*").alias("c"), F.min("x").alias("x")))
        ranked = running_totals(groups, "x", ["c"]).withColumn("upto", F.col("all_c") - F.col("cum_c") + F.col("c"))
        ranks = [(head["n"] - 1) * q for q in shares]
        picks = []
        for i, r in enumerate(ranks):
            for j, want in enumerate((math.floor(r), math.ceil(r))):
                first = F.min_by(F.struct("v"), F.when(F.col("upto") > want, F.col("upto")))
                picks.append(first.alias(f"q{i}_{j}"))
        found = ranked.agg(*picks).first()
        pairs = [(found[f"q{i}_0"]["v"], found[f"q{i}_1"]["v"]) for i in range(len(shares))]
        if all(v is not None for pair in pairs for v in pair):
            return [a + (b - a) * (r - math.floor(r)) for (a, b), r in zip(pairs, ranks)]
        slack *= 8


def exact_quantile(df: DataFrame, value: str, share: float, accuracy: int = 100_000) -> float | None:
    return exact_quantiles(df, value, [share], accuracy)[0]


def draw_order(row_id: str, seed: int | str) -> Column:
    """A seeded pseudo-random order: the hex md5 of the id and the seed."""
    return F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))


def draw_sample(df: DataFrame, key: str, seed: int | str, rows: int) -> DataFrame:
    """The ``rows`` rows that come first in draw order, for a small bounded number of rows.

    Draws are uniform, so a threshold leaves about twice the wanted rows; only those are
    ordered. Were they too few, all rows would be ordered instead.
    """
    drawn = df.withColumn("_d", draw_order(key, seed))
    n = df.count()
    if n > 8 * rows:
        near = drawn.where(F.col("_d") < format(int(2 * rows / n * 16 ** 12), "012x"))
        if not within(near, rows - 1):
            drawn = near
    return drawn.orderBy("_d").limit(rows).drop("_d")


MAX_CLASSES = 1000


def class_sizes(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> dict:
    """Rows per class, null being one. A label with more than ``max_classes`` values is an error."""
    rows = df.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values and is no class label")
    return {r["c"]: r["n"] for r in rows}


def of_value(column: Column, value) -> Column:
    """True where the column holds the value; null is a value like others."""
    return column.isNull() if value is None else column.eqNullSafe(F.lit(value))


def draw_cutoffs(df: DataFrame, want: Mapping, label: str, draw: Column, digits: int = 4) -> dict:
    """Per class, the draw value of its ``want``-th row in draw order; one value per class.

    A histogram over the first hex digits finds the bucket where the count is reached, and
    only that bucket is ranked, so no class is ever sorted as a whole.
    """
    wanted = {c: n for c, n in want.items() if n > 0}
    if not wanted:
        return {}
    rows = df.select(F.col(label).alias("c"), draw.alias("d")).withColumn("p", F.substring("d", 1, digits))

    def of_class(values: Mapping, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for c, v in values.items():
            out = F.when(of_value(F.col("c"), c), F.lit(v)).otherwise(out)
        return out

    upto = F.sum("n").over(W.partitionBy("c").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    reached = (
        rows.groupBy("c", "p").agg(F.count("*").alias("n"))
        .withColumns({"upto": upto, "want": of_class(wanted, "long")})
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        .select("c", "p", (F.col("want") - F.col("upto") + F.col("n")).alias("nth")).collect()
    )
    bucket, nth = {r["c"]: r["p"] for r in reached}, {r["c"]: r["nth"] for r in reached}
    rank = F.row_number().over(W.partitionBy("c").orderBy("d"))
    found = rows.where(F.col("p") == of_class(bucket, "string")).withColumn("r", rank).where(
        F.col("r") == of_class(nth, "long")).collect()
    return {r["c"]: r["d"] for r in found}


def draw_rank(df: DataFrame, label: str, draw: str, out: str, digits: int = 4) -> DataFrame:
    """Rank of every row in its label's draw order.

    Each label is cut by the first hex digits of the draw, which are uniform; counts per
    cut (at most 16**digits per label) give the offsets.
    """
    rows = df.withColumn("_p", F.substring(draw, 1, digits))
    before = W.partitionBy(label).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(label, "_p").agg(F.count("*").alias("_c"))
        .select(label, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    )
    inside = W.partitionBy(label, "_p").orderBy(draw)
    return (
        _null_safe(rows, offsets, [label, "_p"])
        .withColumn(out, F.row_number().over(inside) + F.col("_o"))
        .drop("_p", "_o")
    )
