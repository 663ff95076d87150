"""Spelling variants: words that differ by one code point, found by sorted permuterm rotations.

Every word gets a terminator and is written in all its rotations. A rotation that starts
behind position i ends in the code point at i; without it, it is the prefix that all words
share which differ at i only (a replacement), and it is a whole rotation of the word that
lacks this code point (an insertion or deletion). So one-edit neighbours are the rows that
share a prefix. The rows are dealt and sorted by prefix, and each group is scanned once:
every member gets the number of its neighbours in the group and the best of them. A group
has one row per code point at the skipped place, so its size is bounded by the alphabet and
no pairs are made. A deletion inside a run of equal code points counts once, at the start of
the run.

Prefixes longer than `long` code points are represented by a 127-bit polynomial hash, which
is computed for all rotations of a word in one pass, and their words by a reference of
bounded size; time and space stay linear in the length of a word.

Null, empty and letterless texts give no words; a null id is an empty one in the checksum.
Repeated rows count as often as they occur. Texts may have any length. Other columns are
not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.common import LOWER, UPPER, ranked, stored

#: Letters of a run; the terminator is none of them.
LETTERS = r"A-Za-zÀ-ÿ"
END = "$"
PRIME = (1 << 127) - 1
BASE = 0x6F1D2C3B4A5968778695A4B3C2D1E0F1
ROTATIONS = "key string, ref string, n long, kind int"
#: The whole rotation of a word; a rotation without its last code point; the same at the start of a run.
WHOLE, SKIPPED, SKIPPED_FIRST = 0, 1, 2


@dataclass(frozen=True)
class Spelling:
    least_length: int = 7
    least_count: int = 2
    #: A form has at least this many times the occurrences of the word.
    ratio: int = 10
    #: One run in `damage` loses a code point before words are counted; 0 leaves all as they are.
    damage: int = 31
    #: Code points up to which a prefix is kept as text.
    long: int = 64


def counted_words(docs: DataFrame, p: Spelling, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: the words of enough length and enough occurrences."""
    runs = F.regexp_extract_all(F.col(text_column), F.lit(f"[{LETTERS}]{{{p.least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    found = found.select("_id", F.translate("_run", UPPER, LOWER).alias("word"))
    if p.damage:
        h = F.crc32(F.concat("_id", F.lit(":"), "word"))
        place = (h % F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
        found = found.select(F.when(h % p.damage == 0, cut).otherwise(F.col("word")).alias("word"))
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.char_length("word") >= p.least_length) & (F.col("n") >= p.least_count))


def hashed_rotations(word: str, longer: int) -> Iterator[tuple[str, int]]:
    """(key, kind) of all rotations of the marked word whose prefix has more than `longer` code points."""
    marked, size = word + END, len(word) + 1
    power, before = [1], [0]
    for c in marked:
        power.append(power[-1] * BASE % PRIME)
        before.append((before[-1] * BASE + ord(c) + 1) % PRIME)

    def key(start: int, stop: int) -> str:  # the marked word from `start` on, then its beginning up to `stop`
        tail = (before[size] - before[start] * power[size - start]) % PRIME
        return f"#{(tail * power[stop] + before[stop]) % PRIME:x}"

    if size > longer:
        for k in range(size):
            yield key(k, k), WHOLE
    if size - 1 > longer:
        for k in range(size - 1):
            yield key(k + 1, k), SKIPPED if k and word[k - 1] == word[k] else SKIPPED_FIRST


def _long_rotations(p: Spelling):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, word, n in zip(*(batch[c] for c in ("ref", "word", "n")), strict=True):
                keys, kinds = [], []
                for key, kind in hashed_rotations(word.as_py(), p.long):
                    keys.append(key)
                    kinds.append(kind)
                    if len(keys) == 10_000:
                        yield _rows(keys, kinds, ref.as_py(), n.as_py())
                        keys, kinds = [], []
                if keys:
                    yield _rows(keys, kinds, ref.as_py(), n.as_py())

    return make


def _rows(keys: list[str], kinds: list[int], ref: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "key": keys, "ref": pa.array([ref] * len(keys)), "n": pa.array([n] * len(keys), pa.int64()), "kind": pa.array(kinds, pa.int32())})


def rotations(words: DataFrame, p: Spelling) -> DataFrame:
    """key, ref, n, kind of all rotations of the stored words (ref, word, n)."""
    size = F.char_length("word")
    marked = F.concat("word", F.lit(END))

    def turned(start: Column, stop: Column) -> Column:
        return F.concat(F.substring(marked, start, size + 1), F.substring(marked, F.lit(1), stop))

    at, here = F.col("_k"), lambda k: F.substring("word", k, F.lit(1))
    first = (at == 1) | (here(at) != here(at - 1))
    whole = words.where(size < p.long).select("*", F.explode(F.sequence(F.lit(0), size)).alias("_k"))
    skipped = words.where(size <= p.long).select("*", F.explode(F.sequence(F.lit(1), size)).alias("_k"))
    short = whole.select(turned(at + 1, at).alias("key"), "ref", "n", F.lit(WHOLE).alias("kind")).union(
        skipped.select(turned(at + 1, at - 1).alias("key"), "ref", "n", F.when(first, SKIPPED_FIRST).otherwise(SKIPPED).alias("kind")))
    long = words.where(size >= p.long).select("ref", "word", "n")
    return short.union(long.repartition(F.col("ref")).mapInArrow(_long_rotations(p), ROTATIONS))


def neighbours(rows: DataFrame) -> DataFrame:
    """ref, n_near, best (struct of -n and ref) of every word with one-edit neighbours; several rows a word."""
    group = Window.partitionBy("key")
    order = group.orderBy(F.col("kind") == WHOLE, F.col("n").desc(), "ref")
    whole_group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("less"), F.col("ref").alias("ref"))
    seen = rows.select(
        "ref", "kind",
        F.count("*").over(whole_group).alias("_all"),
        F.count_if(F.col("kind") != WHOLE).over(whole_group).alias("_skipped"),
        F.count_if(F.col("kind") == SKIPPED_FIRST).over(whole_group).alias("_first"),
        F.max(F.when(F.col("kind") == WHOLE, one)).over(whole_group).alias("_whole"),
        F.min(F.when(F.col("kind") == SKIPPED_FIRST, one)).over(whole_group).alias("_best_first"),
        F.first(one).over(whole_group).alias("_1"),
        F.nth_value(F.when(F.col("kind") != WHOLE, one), 2).over(whole_group).alias("_2"),
        F.row_number().over(order).alias("_at"),
    ).where("_all > 1")
    beside = F.when(F.col("_at") == 1, F.col("_2")).otherwise(F.col("_1"))
    shorter = F.when(F.col("kind") == SKIPPED_FIRST, F.col("_whole"))
    is_whole = F.col("kind") == WHOLE
    found = F.when(is_whole, F.col("_first")).otherwise(
        F.col("_skipped") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(is_whole, F.col("_best_first")).otherwise(F.least(beside, shorter))
    return seen.select("ref", found.alias("n_near"), best.alias("best")).where("n_near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """ref, root: the last word that following forms from `ref` reaches. `forms` is stored: ref, form.

    Forms have ever more occurrences, so they cannot return; each round doubles the steps taken.
    """
    found = forms.select("ref", F.col("form").alias("root"))
    while True:
        further = found.select(F.col("ref").alias("_from"), F.col("root").alias("_to"))
        found = stored(found.join(further, F.col("root") == F.col("_from"), "left").select(
            "ref", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        moved = not found.where("_moved").isEmpty()
        found = found.select("ref", "root")
        if not moved:
            return found


def spelling_variants(docs: DataFrame, p: Spelling = Spelling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; see the module for odd rows.

    Neighbours tie on the smaller word in code-point order.
    """
    counts = stored(counted_words(docs, p, id_column, text_column))
    is_long = F.char_length("word") >= p.long
    # The order of references is the order of the words they stand for.
    place = F.concat(F.substring("word", 1, p.long), F.lit("\0"), F.lpad(F.col("_place").cast("string"), 19, "0"))
    long = stored(ranked(counts.where(is_long), [], ["word"], "_place").select(place.alias("ref"), "word", "n"))
    words = counts.where(~is_long).select(F.col("word").alias("ref"), "word", "n").union(long)
    near = neighbours(rotations(words, p))
    none = F.lit(None).cast("struct<less: bigint, ref: string>")
    every = near.withColumn("n", F.lit(None).cast("long")).union(
        words.select("ref", F.lit(0).cast("long").alias("n_near"), none.alias("best"), "n"))
    met = every.groupBy("ref").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    fit = -F.col("best.less") >= p.ratio * F.col("n")
    met = stored(met.select(
        "ref", "n", "n_near", F.when(fit, F.col("best.ref")).alias("form"), F.when(fit, -F.col("best.less")).alias("form_n")))
    ends = roots(met.where("form is not null").select("ref", "form"))
    with_form = met.where("form is not null").join(ends, "ref").select("ref", "form", "root", "n", "n_near", "form_n")
    result = stored(with_form.union(met.where("form is null").select("ref", "form", F.col("ref").alias("root"), "n", "n_near", "form_n")))
    refs = ["ref", "form", "root"]
    stands_for = F.lit(False)
    for c in refs:
        stands_for = stands_for | F.coalesce(F.contains(c, F.lit("\0")), F.lit(False))
    named = result.where(stands_for)
    for c in refs:
        names = long.select(F.col("ref").alias("_ref"), F.col("word").alias("_word"))
        named = named.join(names, F.col(c) == F.col("_ref"), "left").withColumn(c, F.coalesce("_word", c)).drop("_ref", "_word")
    return result.where(~stands_for).unionByName(named).withColumnRenamed("ref", "word")
