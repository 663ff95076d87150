"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with equal
   sets share a 128-bit fingerprint; only the smallest id of each goes on.
2. `bands` x `rows` minima are taken of the set. The minima of a band make its bucket key;
   of every minimum the low `bits` bits are kept, packed as bit planes.
3. In a bucket every member is paired with the smallest id (a star, not all pairs). The
   share of equal low bits, counted on the planes and corrected for chance equality, must
   reach the threshold less `slack`; then the full sets decide. The links give components.
4. Where a bucket still holds several components, its members get a second signature of
   `fine_hashes` minima, whose estimate is as much sharper. Members of different components
   are paired under that estimate, and the full sets decide again. Members of one component
   are never paired, so a bucket of copies costs as many pairs as members.

The chance that a pair at the threshold shares no band is (1 - 0.75 ** rows) ** bands, 5e-6
by default; that it fails the estimate, about 3e-7 (five deviations).

Null, empty or blank text: no shingles, linked with nothing, its own component. Rows that
share a doc_id are one document with several texts; links of any of them count for it.
Null doc_id: linked with nothing, component_id and kept are null. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Scratch, rows_per_batch, slices, stored
from shelfscope.llm.components import connected_components
from shelfscope.llm.hashing import mix, shingle_hashes, word_hashes


@dataclass(frozen=True)
class NearDedup:
    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 4
    slack: float = 0.2
    #: Minima and low bits of the second signature; five deviations of its estimate are 0.085.
    fine_hashes: int = 1024
    fine_bits: int = 2
    fine_slack: float = 0.085
    #: Members of a bucket that one task compares with as many others.
    block: int = 1024
    seed: int = 11
    #: Texts, and pairs with both their sets, that stand in one Arrow batch at most.
    batch: int = 1000
    pair_batch: int = 128
    #: Size of the bitmap of ids whose texts are read again; a power of two.
    filter_bits: int = 1 << 24

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, planes array<long>, bands array<long>"


def _minima(shingles: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """The smallest of the high 32 bits of a * x + b, for each hash function."""
    salt = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
    a, b = salt[:hashes] | np.uint64(1), salt[hashes:]
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        some = shingles[k : k + 1024, None] * a
        some += b
        np.minimum(least, some.min(axis=0), out=least)
    return least >> np.uint64(32)


def _planes(minima: np.ndarray, bits: int) -> np.ndarray:
    """Bit plane k holds bit k of every minimum, 64 minima to an integer."""
    low = np.zeros((bits, -(-len(minima) // 64) * 64), np.uint8)
    for k in range(bits):
        low[k, : len(minima)] = (minima >> np.uint64(k)) & np.uint64(1)
    return np.packbits(low, axis=1, bitorder="little").view(np.int64).ravel()


def _band_keys(minima: np.ndarray, p: NearDedup) -> np.ndarray:
    keys = np.arange(1, p.bands + 1, dtype=np.uint64)
    for column in minima.reshape(p.bands, p.rows).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """Set size, fingerprint, bit planes and band keys of each text; null where the set is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t.encode() for t in batch["text"].to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            for words in word_hashes(texts):
                s = shingle_hashes(words, p.words)
                cols[0].append(len(s))
                if len(s):
                    minima = _minima(s, p.hashes, p.seed)
                    row = (int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), _planes(minima, p.bits), _band_keys(minima, p))
                else:
                    row = (None, None, None, None)
                for c, v in zip(cols[1:], row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_shingles", "f1", "f2", "planes", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, SIGNATURES)


def shingle_sets(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id and the sorted shingle hashes of the text as bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_hashes(w, p.words).tobytes() for w in word_hashes([t.encode() for t in batch["text"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(gather, "doc_id long, shingles binary")


def fine_planes(docs: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id and the bit planes of the second signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            planes = []
            for words in word_hashes([t.encode() for t in batch["text"].to_pylist()]):
                planes.append(_planes(_minima(shingle_hashes(words, p.words), p.fine_hashes, p.seed + 1), p.fine_bits))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(planes, pa.list_(pa.int64()))], ["doc_id", "fine"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, fine array<long>")


def similar_bits(x: Column, y: Column, hashes: int, bits: int) -> Column:
    """Estimated similarity from two arrays of bit planes: equal low bits, less those equal by chance."""
    lanes = -(-hashes // 64)
    differing = F.lit(0)
    for lane in range(lanes):
        differs = F.lit(0).cast("long")
        for k in range(bits):
            at = k * lanes + lane
            differs = differs.bitwiseOR(x[at].bitwiseXOR(y[at]))
        differing = differing + F.bit_count(differs)
    chance = 2.0**-bits
    return ((1.0 - differing / F.lit(float(hashes))) - F.lit(chance)) / F.lit(1.0 - chance)


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sx"], batch["sy"], strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int(np.count_nonzero(b[at] == a))
                keep.append(100 * shared >= p.percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sy"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(decide, "a long, b long")


#: The bit of an id in its 64-bit word: the low bits of its hash.
_BIT = "shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))"


def _word(bits: int) -> Column:
    return F.shiftright(F.pmod(F.xxhash64("doc_id"), F.lit(bits)), 6).alias("_word")


def _marked(ids: DataFrame, bits: int) -> DataFrame:
    """A bitmap of the hashed ids, one row per 64 bits that are not all zero: at most bits / 64 rows."""
    return ids.select(_word(bits), F.expr(f"{_BIT} as _bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def only_marked(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """Rows of docs whose doc_id is in ids. A bitmap of bounded size, sent to every task, holds back most
    other rows, with their texts, before the join decides."""
    near = docs.select("*", _word(bits)).join(F.broadcast(_marked(ids, bits)), "_word").where(f"(_bits & {_BIT}) <> 0")
    return near.select(*docs.columns).join(ids, "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame, bits: int = NearDedup.filter_bits) -> DataFrame:
    """Rows of docs whose doc_id is not in ids. Rows that the bitmap does not mark stay where they are; the join decides on the others."""
    seen = docs.select("*", _word(bits)).join(F.broadcast(_marked(ids, bits)), "_word", "left")
    marked = F.coalesce(F.expr(f"_bits & {_BIT}"), F.lit(0)) != 0
    doubtful = seen.where(marked).select(*docs.columns).join(ids, "doc_id", "left_anti")
    return seen.where(~marked).select(*docs.columns).union(doubtful.select(*docs.columns))


def _across(members: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs a < b of one bucket and different components that look alike by their fine planes.

    A bucket is cut into blocks of about `block` members, and each task compares two blocks.
    """
    lanes = -(-p.fine_hashes // 64)
    chance = 2.0**-p.fine_bits
    most = p.fine_hashes * (1 - (p.percent / 100 - p.fine_slack)) * (1 - chance)

    def compare(table: pa.Table) -> pa.Table:
        ids, parts, blocks = (table[c].to_numpy() for c in ("doc_id", "component", "_block"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), p.bands)
        bucket = table["bucket"][0].as_py()
        planes = table["fine"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), p.fine_bits, lanes)
        first, second = table["_i"][0].as_py(), table["_j"][0].as_py()
        rows, cols = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
        found = [np.empty((0, 2), np.int64)]
        for k in range(0, len(rows), 64):
            r = rows[k : k + 64]
            differs = np.bitwise_or.reduce(planes[r, None] ^ planes[None, cols], axis=2)
            alike = np.bitwise_count(differs).sum(axis=2, dtype=np.int64) <= most
            x, y = np.nonzero(alike & (parts[r, None] != parts[None, cols]))
            x, y = r[x], cols[y]
            # A pair may share several buckets; the one of their first common band hands it on.
            common = (bands[x] == bands[y]).argmax(axis=1)
            mine = (bands[x, common] == bucket) & ((first != second) | (x < y))
            found.append(np.stack([ids[x[mine]], ids[y[mine]]], axis=1))
        pairs = np.sort(np.concatenate(found), axis=1)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / p.block).cast("int").alias("_blocks"))
    cut = members.select("bucket", "doc_id", "component", "fine", "bands").join(sizes, "bucket").withColumn(
        "_block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    paired = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_blocks", "_other")
    return paired.groupBy("bucket", "_i", "_j").applyInArrow(compare, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, p: NearDedup, keep: Scratch) -> DataFrame:
    """Pairs a, b that the full sets confirm. Only texts that stand in a pair are read into sets again."""
    pairs = keep.stored(pairs)
    ids = keep.stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = keep.stored(shingle_sets(only_marked(docs, ids, p.filter_bits), p))
    with rows_per_batch(docs.sparkSession, p.pair_batch):
        return keep.stored(_verified(pairs, sets, p).distinct())


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    with Scratch(docs.sparkSession, "near-dedup") as keep, rows_per_batch(docs.sparkSession, p.batch):
        return stored(_near_duplicates(docs, p, keep), "near-duplicates")


def _near_duplicates(docs: DataFrame, p: NearDedup, keep: Scratch) -> DataFrame:
    signed = keep.stored(signatures(docs, p))
    usable = signed.where("doc_id is not null and f1 is not null")
    # One representative of each set: its smallest id. Equal sets have equal planes and bands.
    reps = keep.stored(usable.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("doc_id"), F.first("planes").alias("planes"), F.first("bands").alias("bands")))
    planes = reps.select("doc_id", "planes")

    banded = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_last")).where("centre <> _last")
    members = keep.stored(banded.join(shared.select("bucket", "centre"), "bucket"))

    stars = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    x = planes.select(F.col("doc_id").alias("a"), F.col("planes").alias("px"))
    y = planes.select(F.col("doc_id").alias("b"), F.col("planes").alias("py"))
    near = similar_bits(F.col("px"), F.col("py"), p.hashes, p.bits) >= p.percent / 100 - p.slack
    links = _links(stars.join(x, "a").join(y, "b").where(near).select("a", "b").distinct(), docs, p, keep)
    # A doc_id with several sets belongs to several classes; it ties their representatives.
    several = usable.groupBy("doc_id").agg(F.min("f1").alias("_x"), F.max("f1").alias("_y")).where("_x <> _y").select("doc_id")
    classes = reps.select("f1", "f2", F.col("doc_id").alias("rep"))
    tied = usable.select("doc_id", "f1", "f2").join(several, "doc_id").join(classes, ["f1", "f2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = keep.stored(connected_components(links.union(tied), keep))

    named = members.select("bucket", "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = keep.stored(named.withColumn("component", F.coalesce("component", "doc_id")))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y")
    left = keep.stored(labelled.join(several.select("bucket"), "bucket"))
    ids = keep.stored(left.select("doc_id").distinct())
    bands = reps.select("doc_id", "bands").join(ids, "doc_id", "left_semi")
    left = left.join(keep.stored(fine_planes(only_marked(docs, ids, p.filter_bits), p).join(bands, "doc_id")), "doc_id")
    more = _links(_across(left, p).distinct().join(stars, ["a", "b"], "left_anti"), docs, p, keep)
    if more.limit(1).count():
        ends = (
            more.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        joined = keep.stored(connected_components(ends, keep)).toDF("component", "whole")
        old = found.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
        new = joined.toDF("id", "whole").join(found, "id", "left_anti").toDF("id", "component")
        found = keep.stored(old.union(new))

    named = classes.join(found.toDF("rep", "component"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
