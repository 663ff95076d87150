"""Language-model score by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions. A decision is a node (the bits of the byte so far,
with a leading one) in the context of the last 0 to `depth` bytes. For every context and
node the training texts give counts of zeros and ones; their Krichevsky-Trofimov block
probability Pe depends on the counts alone, so

    Pw(deepest) = Pe,    Pw = (Pe + product of Pw over the contexts one byte longer) / 2

is a sum by parent context, level by level, and Pe / (2 Pw) is the weight of stopping at a
context. The predictive probability of a bit mixes the estimates (n + 1/2) / (n0 + n1 + 1)
of all depths with these weights, top down. The product over eight bits gives the
probability of a byte after its context: one number for each distinct gram (context and
byte) of the corpus. A text's score is the sum over its grams.

Grams and words are counted by Spark over all documents; grams that only held-out texts
have carry zero counts, which the weighting treats as unseen. The `hot` most frequent
grams and words go to every task; the others are joined by shuffle, with the same sum.

A text ends with byte 0xFF (never part of UTF-8) and begins after `depth` such bytes.
Null or empty text: the end alone. No training row: all estimates are one half, and the
base probability of a token is that of an empty count table. Repeated rows: each is scored.
Null doc_id: held out, scored. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Scratch, slices, stored
from shelfscope.llm.hashing import word_hashes

END = 0xFF
#: Key of the end token among word hashes.
END_TOKEN = 0x0FE11D5EED5EED01


@dataclass(frozen=True)
class ContextTree:
    depth: int = 4
    #: Entries of a table that go to every task; the rest is joined.
    hot: int = 1 << 18
    #: Bytes whose grams are counted together.
    together: int = 1 << 21
    #: Distinct keys of a kind that a task holds before it hands them on.
    entries: int = 1 << 20


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in order, as integers, and the number of each text."""
    start = bytes([END]) * depth
    raw = np.frombuffer(b"".join(x for t in texts for x in (start, t, b"\xff")), np.uint8)
    gram = np.zeros(len(raw), np.int64)
    for back in range(depth + 1):
        part = raw[: len(raw) - back].astype(np.int64) << (8 * back) if back else raw.astype(np.int64)
        gram[back:] |= part
    counts = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(counts + depth) - counts
    keep = np.ones(len(raw), bool)
    for k in range(1, depth + 1):
        keep[first - k] = False
    return gram[keep], counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of several tables of key, n, uses."""
    keys, n, uses = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return keys, n, uses
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(uses[order], first)


def _count(docs: DataFrame, p: ContextTree) -> DataFrame:
    """kind (0 gram, 1 word), key, n in training rows, uses in all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {0: [], 1: []}
        entries = {0: 0, 1: 0}

        def take(kind: int, keys: np.ndarray, learned: np.ndarray) -> Iterator[pa.RecordBatch]:
            for n, some in ((1, keys[learned]), (0, keys[~learned])):
                key, uses = np.unique(some, return_counts=True)
                kept[kind].append((key, n * uses, uses))
                entries[kind] += len(key)
            if entries[kind] > 2 * p.entries:
                kept[kind] = [_merged(kept[kind])]
                entries[kind] = len(kept[kind][0][0])
                if entries[kind] > p.entries:
                    yield from flush(kind)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if kept[kind]:
                key, n, uses = _merged(kept[kind])
                kept[kind], entries[kind] = [], 0
                for k in range(0, len(key), 100_000):
                    cols = [np.full(len(key[k : k + 100_000]), kind, np.int8), *(c[k : k + 100_000] for c in (key, n, uses))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "key", "n", "uses"])

        def sums(texts: list[bytes], train: np.ndarray) -> Iterator[pa.RecordBatch]:
            gram, sizes = grams(texts, p.depth)
            yield from take(0, gram, np.repeat(train, sizes))
            words = [np.append(w, np.uint64(END_TOKEN)) for w in word_hashes(texts)]
            yield from take(1, np.concatenate(words).view(np.int64), np.repeat(train, [len(w) for w in words]))

        texts, train, held = [], [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for text, learned in zip(batch["text"].to_pylist(), batch["train"].to_pylist(), strict=True):
                raw = text.encode()
                if texts and held + len(raw) > p.together:
                    yield from sums(texts, np.array(train))
                    texts, train, held = [], [], 0
                texts.append(raw)
                train.append(learned)
                held += len(raw)
        if texts:
            yield from sums(texts, np.array(train))
        for kind in kept:
            yield from flush(kind)

    counted = docs.select("text", "train").mapInArrow(count, "kind byte, key long, n long, uses long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1/2, by Stirling's series at x + 8."""
    shift = F.lit(1.0)
    for k in range(8):
        shift = shift * (x + k)
    z = x + 8.0
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def _log_block(n0: Column, n1: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a block with these counts."""
    known = _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)
    return F.when(n0 + n1 > 0, known).otherwise(0.0)


def _bits(gram: Column, n: Column) -> Column:
    """The eight decisions of the last byte of a gram: node and counts."""
    byte = gram.bitwiseAND(F.lit(255))
    rows = []
    for j in range(8):
        node = (F.shiftright(byte, 8 - j) + (1 << j)).cast("int")
        bit = F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1))
        rows.append(F.struct(node.alias("node"), bit.cast("int").alias("bit"), n.alias("n")))
    return F.explode(F.array(*rows))


def gram_scores(counts: DataFrame, p: ContextTree, keep: Scratch) -> DataFrame:
    """key, score: log10 of the probability of the byte after its context, for each gram."""
    levels: list[DataFrame] = []
    decided = counts.select(F.shiftright("key", 8).alias("context"), _bits(F.col("key"), F.col("n")).alias("d"))
    level = decided.groupBy("context", F.col("d.node").alias("node")).agg(
        F.sum(F.when(F.col("d.bit") == 0, F.col("d.n")).otherwise(0)).cast("double").alias("n0"),
        F.sum(F.when(F.col("d.bit") == 1, F.col("d.n")).otherwise(0)).cast("double").alias("n1"))
    block = _log_block(F.col("n0"), F.col("n1"))
    # Bottom up: counts and the product over longer contexts, by parent context.
    level = keep.stored(level.withColumn("pe", block).withColumn("pw", F.col("pe")))
    levels.append(level)
    for d in range(p.depth - 1, -1, -1):
        parent = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context")
        up = levels[-1].groupBy(parent, "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("longer"))
        up = up.withColumn("pe", block)
        high, low = F.greatest("pe", "longer"), F.least("pe", "longer")
        up = up.withColumn("pw", high + F.log1p(F.exp(low - high)) - math.log(2.0)).drop("longer")
        levels.append(keep.stored(up))
    # Top down: the mixed estimate of a one so far, and the weight that is left for longer contexts.
    above = None
    for d, here in enumerate(reversed(levels)):
        stop = F.lit(1.0) if d == p.depth else F.exp(F.col("pe") - F.col("pw")) / 2
        one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        here = here.withColumn("_stop", F.least(F.lit(1.0), stop)).withColumn("_one", one).select("context", "node", "_stop", "_one")
        if above is None:
            here = here.withColumn("mixed", F.lit(0.0)).withColumn("rest", F.lit(1.0))
        else:
            here = here.withColumn("_parent", F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))).join(
                above.withColumnRenamed("context", "_parent"), ["_parent", "node"])
        above = here.select(
            "context", "node", (F.col("mixed") + F.col("rest") * F.col("_stop") * F.col("_one")).alias("mixed"),
            (F.col("rest") * (1.0 - F.col("_stop"))).alias("rest"))
        above = keep.stored(above)
    asked = counts.select("key", F.shiftright("key", 8).alias("context"), _bits(F.col("key"), F.col("n")).alias("d"))
    asked = asked.select("key", "context", F.col("d.node").alias("node"), F.col("d.bit").alias("bit"))
    chance = F.when(F.col("bit") == 1, F.col("mixed")).otherwise(1.0 - F.col("mixed"))
    return asked.join(above, ["context", "node"]).groupBy("key").agg(F.sum(F.log10(chance)).alias("score"))


class Lookup:
    """Open addressing over integer keys: values[slot] of a key, or -1 where the key is not held."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            self.keys[slot[free]] = keys[left[free]]
            settled = self.place[slot] == left
            left, slot = left[~settled], (slot[~settled] + 1) & ((1 << self.bits) - 1)
        # two keys may have written one slot: the last place written there holds its own key
        taken = self.place >= 0
        self.keys[taken] = keys[self.place[taken]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.place[slot]
        far = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(far):
            slot[far] = (slot[far] + 1) & ((1 << self.bits) - 1)
            out[far] = self.place[slot[far]]
            far = far[(out[far] >= 0) & (self.keys[slot[far]] != keys[far])]
        return out


def most_used(table: DataFrame, most: int, columns: list[str]) -> dict[str, np.ndarray]:
    """The entries above a number of uses, chosen from a histogram so that there are at most `most`."""
    step = F.floor(F.log2("uses") * 16)
    steps = table.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.col("step").desc()).collect()
    least, rows = None, 0
    for s in steps:  # a few hundred steps, however many entries
        if rows + s["rows"] > most:
            break
        least, rows = s["step"], rows + s["rows"]
    found = table.where(step >= least if least is not None else F.lit(False)).select(*columns).toArrow()
    return {c: found[c].to_numpy() for c in columns}


def scored(docs: DataFrame, train: Column, p: ContextTree = ContextTree(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte of every row; `train` rows are learned from."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), train.alias("train"))
    with Scratch(docs.sparkSession, "context-tree") as keep:
        return stored(_scored(docs, p, keep), "scored")


def _scored(docs: DataFrame, p: ContextTree, keep: Scratch) -> DataFrame:
    spark = docs.sparkSession
    counts = keep.stored(_count(docs, p))
    words = counts.where("kind = 1")
    total, distinct = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = F.log10((F.col("n") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))
    gram_counts = counts.where("kind = 0")
    gram_table = keep.stored(gram_scores(gram_counts, p, keep).join(gram_counts.select("key", "uses"), "key"))
    word_table = keep.stored(words.select("key", "uses", "n", base.alias("score")))
    hot_words = most_used(word_table, p.hot, ["key", "score", "n"])
    hot_grams = most_used(gram_table, p.hot, ["key", "score"])
    sent = spark.sparkContext.broadcast({
        "words": hot_words["key"], "base": hot_words["score"], "known": hot_words["n"] > 0, "grams": hot_grams["key"], "score": hot_grams["score"]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row of what the hot tables give, and a row for each of its other keys."""
        hot = sent.value
        word_at, gram_at = Lookup(hot["words"]), Lookup(hot["grams"])

        def summed(at: np.ndarray, owner: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
            held = at >= 0
            return np.bincount(owner[held], weights=values[at[held]], minlength=texts)

        def rest(at: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            other = at < 0
            pair = np.stack([owner[other], keys[other]], axis=1)
            if not len(pair):
                return pair[:, 0], pair[:, 1], pair[:, 0]
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])
            at = np.flatnonzero(new)
            return pair[at, 0], pair[at, 1], np.diff(np.append(at, len(pair)))

        # A row's number is made here and stored with its parts, since ids may be null or repeated.
        number = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t.encode() for t in batch["text"].to_pylist()]
            row = np.arange(number, number + len(texts))
            number += len(texts)
            gram, sizes = grams(texts, p.depth)
            word = [np.append(w, np.uint64(END_TOKEN)) for w in word_hashes(texts)]
            tokens = np.fromiter(map(len, word), np.int64, len(word))
            n = len(texts)
            owner, owner_w, word = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), tokens), np.concatenate(word).view(np.int64)
            at, at_w = gram_at(gram), word_at(word)
            parts = [(
                np.full(n, 2, np.int8), row, np.zeros(n, np.int64), tokens, sizes - 1, summed(at_w, owner_w, hot["base"], n),
                summed(at_w, owner_w, hot["known"].astype(float), n), summed(at, owner, hot["score"], n))]
            for kind, (o, k, c) in ((0, rest(at, owner, gram)), (1, rest(at_w, owner_w, word))):
                zero = np.zeros(len(o))
                parts.append((np.full(len(o), kind, np.int8), row[o], k, c, np.zeros(len(o), np.int64), zero, zero, zero))
            names = ["kind", "row", "key", "n", "bytes", "base", "known", "score", "doc_id", "train"]
            cols = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            behind = len(cols[0]) - n
            own = [pa.concat_arrays([batch[c], pa.nulls(behind, batch[c].type)]) for c in names[8:]]
            yield pa.RecordBatch.from_arrays(cols + own, names)

    kind = "kind byte, row long, key long, n long, bytes long, base double, known double, score double, doc_id long, train boolean"
    found = keep.stored(docs.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(add, kind))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    sure = found.where("kind = 2").select("row", F.col("n").alias("tokens"), "bytes", "base", "known", "score")
    rare_grams = found.where("kind = 0").select("row", "key", "n").join(gram_table.select("key", "score"), "key").select(
        "row", none, none, zero, zero, F.col("n") * F.col("score"))
    rare_words = found.where("kind = 1").select("row", "key", F.col("n").alias("times")).join(word_table, "key").select(
        "row", none, none, F.col("times") * F.col("score"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("double"), zero)
    summed = sure.union(rare_grams).union(rare_words).groupBy("row").agg(*[F.sum(c).alias(c) for c in sure.columns[1:]])
    return found.where("kind = 2").select("row", "doc_id", "train").join(summed, "row").select(
        "doc_id", (~F.col("train")).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"))
