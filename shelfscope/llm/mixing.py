"""Mixing sources to target weights by systematic sampling.

Every source gets a target size; a document of the source is expected
target / source size times. Within a source the documents stand in order of size, so
the prefix sum of expected copies is rank times that number. One offset in [0, 1) is
added, and a document is emitted once for each integer its step crosses. Since the order
is by size, the words taken differ from the target by less than two largest documents.

Null or empty text: size 0, it may be emitted, it takes no words. Null source: a source
of its own, last in order. Repeated rows: each is a document. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import ranked, stored, word_count

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target: `share` of all sizes by weight, at most `most` times the source's size.

    What a stopped source leaves is shared again by weight until none is above. Each round
    is one sum over the sources; two numbers come back to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = ranked(per, [], ["source"], "_n").withColumn("_w", F.element_at(cycle, ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    per = stored(per.withColumn("_cap", F.col("source_size") * F.lit(float(most))).drop("_n"), "sources")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        at_cap = F.col("_cap") <= F.lit(level) * F.col("_w")
        capped, left = per.agg(
            F.sum(F.when(at_cap, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~at_cap, F.col("_w")).otherwise(0.0))
        ).first()
        if not left:
            break
        if (raised := (total - capped) / left) <= level:
            break
        level = raised
    return per.select("source", "source_size", F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def systematic_copies(sized: DataFrame, targets: DataFrame, id_column: str, seed: int = 17) -> DataFrame:
    """Adds source_size, target and copies to rows with `source` and `size`."""
    rows = ranked(sized, ["source"], ["size", id_column], "_rank")
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}"), name)), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_source"), "source_size", "target", each.alias("_each"))
    joined = rows.join(t, rows["source"].eqNullSafe(t["_source"])).withColumn("_u", drawn)
    crossed = F.floor(F.col("_rank") * F.col("_each") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("_each") + F.col("_u"))
    return joined.withColumn("copies", crossed.cast("int")).drop("_rank", "_source", "_each", "_u")


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
            weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in `carry`, source, size, source_size, target, copies, taken of each document."""
    size = word_count(F.col(text_column))
    sized = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("source"), size.alias("size"))
    if carry:  # the rows are dealt out once, with their texts; the sizes are summed from a pass of its own
        targets = source_targets(sized, weights, share, most)
        sized = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("source"), size.alias("size"), F.struct(*carry).alias("_row"))
    else:
        sized = stored(sized, "sized")
        targets = source_targets(sized, weights, share, most)
    out = systematic_copies(sized, targets, "_id", seed).withColumn("taken", F.col("size") * F.col("copies"))
    own = [F.col("_id").alias(id_column)] if not carry else [F.col("_row")]
    return out.select(*own, "source", "size", "source_size", "target", "copies", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, each as often as the mixture takes it, with their own columns."""
    drawn = mixture(docs, carry=tuple(docs.columns), **parameters)
    each = F.explode(F.array_repeat(F.lit(True), F.col("copies")))
    return drawn.where("copies > 0").withColumn("_copy", each).select("_row.*")
