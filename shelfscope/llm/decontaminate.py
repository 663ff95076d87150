"""Benchmark decontamination: documents that hold at least 75 % of an item's 5-word shingles.

Native DataFrame code only. A short item inside a long document has a tiny Jaccard
similarity (30 shingles in 20,000: 0.0015), so equal-length MinHash signatures of whole
documents would miss it. The sketch is therefore on the item's side and sized by it:

1. Items are partitioned by set size, one partition per power of two. The sketch of an item
   is its k smallest shingle hashes (bottom-k MinHash), k = floor(25 % of the partition's
   largest size) + 1. A document with 75 % of the item lacks fewer than k of its shingles,
   so it holds at least one of the sketch, and all but floor(25 % of the item) of it.
2. Every document keeps only the hashes below the largest sketch value and looks them up
   in the index of sketches; the sure bound on hits leaves the candidates.
3. Candidates are verified on the shingles themselves, as strings.

The index, the items and their shingles are broadcast when rows of the index and rows of the
items stay under `broadcast_rows` and the shingles under `broadcast_bytes`; otherwise all are
joined by shuffle with the same result. Null, empty or blank texts and items have no shingles and
give no pairs; with fewer than five words the whole sequence is the one shingle, on both
sides. Repeated rows give repeated pairs. A null doc_id is carried. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import stored, words

WORDS = 5
PERCENT = 75
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 100_000_000


def _once(value: Column, use) -> Column:
    """use(value) with value computed once: as a lambda's variable it is not copied into each place that names it."""
    return F.transform(F.array(value), use)[0]


def _shingles(tokens: Column, one) -> Column:
    """Shingles of an array of tokens; `one` builds a shingle from its tokens. Null without tokens."""

    def build(t: Column) -> Column:
        n = F.size(t)
        full = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: one([t[i + k] for k in range(WORDS)]))
        return F.when(n >= WORDS, full).when(n > 0, F.array(one([t])))

    return _once(tokens, build)


def _hashes(text: Column) -> Column:
    """Hashes of the shingles of a text, from the hashes of its words."""
    tokens = F.transform(words(text), lambda w: F.xxhash64(w))
    return _shingles(tokens, lambda parts: F.xxhash64(*parts))


def _strings(text: Column) -> Column:
    found = _shingles(words(text), lambda parts: F.concat_ws(" ", *parts))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """_item, n, sketch and strings of each item that has shingles."""
    sets = items.select(
        "_item", F.array_sort(F.array_distinct(_hashes(F.col("text")))).alias("h"), _strings(F.col("text")).alias("strings"))
    sets = sets.where(F.col("h").isNotNull())
    sets = sets.withColumn("n", F.size("h"))
    largest = F.lit(2) * F.pow(F.lit(2.0), F.floor(F.log2("n"))) - 1
    k = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return sets.select("_item", "n", F.slice("h", F.lit(1), k).alias("sketch"), "strings")


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_key, item_id, shared, item_shingles, containment of each document and item it holds."""
    texts = docs.select(
        F.col(doc_id).alias("_doc"), F.col(doc_text).alias("text"), F.xxhash64(F.coalesce(F.col(doc_text), F.lit(""))).alias("_key"))
    held = stored(sketches(items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("text")), percent), "items")
    # Items with the same text are one class: matched once, named again at the end.
    classes = stored(
        held.groupBy(F.concat_ws("\n", F.array_sort("strings")).alias("_same")).agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("strings").alias("strings"))
        .withColumn("_class", F.md5("_same")).drop("_same"), "item-classes")
    named = held.select(F.md5(F.concat_ws("\n", F.array_sort("strings"))).alias("_class"), "_item")
    index = classes.select("_class", F.explode("sketch").alias("h"))
    rows, bound = index.agg(F.count("*"), F.max("h")).first()
    n_bytes = classes.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "strings")) + 16 * F.size("strings")), F.lit(0))).first()[0]
    fits = max(rows, held.count()) <= broadcast_rows and n_bytes <= broadcast_bytes
    small = F.broadcast if fits else (lambda df: df)

    probes = texts.select("_doc", "_key", F.explode(_hashes(F.col("text"))).alias("h")).where(F.col("h") <= F.lit(bound))
    hits = probes.join(small(index), "h").groupBy("_doc", "_key", "_class").agg(F.countDistinct("h").alias("hits"))
    least = F.size("sketch") - F.floor(F.col("n") * (100 - percent) / 100)
    candidates = stored(
        hits.join(small(classes.select("_class", "n", "sketch")), "_class").where(F.col("hits") >= least)
        .select(F.col("_doc").alias("_d"), F.col("_key").alias("_k"), "_class"), "candidates")

    suspects = texts.join(
        candidates.select("_d", "_k").distinct(), (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    suspects = suspects.select("_doc", "_key", _strings(F.col("text")).alias("_set"))
    pairs = suspects.join(candidates, (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_d")))
    checked = pairs.join(small(classes.select("_class", "strings")), "_class").select(
        "_doc", "_key", "_class", F.size(F.array_intersect("_set", "strings")).cast("long").alias("shared"),
        F.size("strings").cast("long").alias("item_shingles"))
    return checked.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).join(small(named), "_class").select(
        F.col("_doc").alias(doc_id), F.col("_key").alias("text_key"), F.col("_item").alias(item_id), "shared", "item_shingles",
        (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    found = contained_items(docs, items, **parameters).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(stored(found, "contaminated"), (key == F.col("_k")) & docs["doc_id"].eqNullSafe(F.col("_d")), "left_anti")
