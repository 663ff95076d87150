"""Alignment of the ids of two tokenizers over the same text, by merge path.

The ends of A's and of B's tokens, as byte offsets, are two ascending lists. Merging them
is a path through a grid; a binary search on a diagonal of the grid finds where the path
crosses it, without the path before. So the diagonals cut the merge into pieces of equal
work that need nothing of each other, and only one piece's arrays are held at a time. A
piece emits its overlaps: each stretch between two neighbouring ends, with the A and the B
token that cover it. Where a stretch ends both, the two tokens are linked and a group ends.
A group that lies across pieces is stitched from what the pieces before left open.

Texts are encoded where they lie. The links of a document are kept as distinct id pairs with
their number, so the pass that weighs links by corpus-wide counts does not encode again.
One of two tokens that end together ends with the bytes of the other. So there are fewer id
pairs than bytes in the two vocabularies (about 500,000 here), whatever the corpus, and the
table of their counts is broadcast under this bound.

Null text, empty text, and texts that a tokenizer does not give back byte by byte have no
tokens: zeros and an empty digest. Null or repeated ids: each row is a document. Texts of any
length: one is held with its units, its ids and ends (16 bytes a token), and one piece of the merge.
Links of equal count tie; all of them count as best. Other columns are not read, so their
names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.common import slices, stored
from shelfscope.llm.token_planes import PieceEncoder, byte_letters

#: Ends that a piece of the merge holds.
WORK = 1 << 16
#: Units whose ids a worker remembers, twice: those in use and those used before; and the characters of the longest.
REMEMBERED = 300_000
LONGEST = 64
PER_DOCUMENT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
                "pairs array<long>, times array<long>")
COUNTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
GROUPS = "doc_id long, piece int, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


class Letters:
    """A: ids of a space and the text by a byte-level vocabulary, and the bytes of every id."""

    def __init__(self, vocabulary: str):
        self.encoder = PieceEncoder(vocabulary)
        # Strings of special tokens in a text are plain text.
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.cut = None
        back = {chr(c): b for b, c in byte_letters().items()}
        known = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        added = self.encoder.tokenizer.get_added_tokens_decoder()
        self.bytes = [b""] * (max(known.values()) + 1)
        for entry, i in known.items():
            self.bytes[i] = entry.encode() if i in added else bytes(back[c] for c in entry)
        # With all bytes as entries and no marks on pieces, merging bytes can lose none of them; sizes then prove the spelling.
        model = self.encoder.tokenizer.model
        self.lossless = self.encoder.tokenizer.normalizer is None and all(c in known for c in back) and not (
            model.continuing_subword_prefix or model.end_of_word_suffix)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encoder.parts(" " + text)), "<u4").astype(np.int64)


class Pieces:
    """B: ids of the text by a piece vocabulary, which puts the space in front, and the bytes of every id."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        # No piece goes on behind a blank, so what lies between blanks is encoded on its own, with the blanks before it.
        self.apart = not any(re.search("[^▁]▁", name) for name in names)
        self.unit = re.compile(r"[ ▁]*[^ ▁]+(?:[ ▁]+\Z)?|[ ▁]+")
        self.code = Units(self).__getitem__

    def spelt(self, unit: str) -> bytes:
        """Ids of a unit, which begins with a blank; none where they do not spell it."""
        ids = self.model.encode(unit[1:])
        return array("I", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == unit.encode() else b""

    def ids(self, text: str) -> np.ndarray:
        units = self.unit.findall(" " + text) if self.apart else [" " + text]
        return np.frombuffer(b"".join(map(self.code, units)), "<u4").astype(np.int64)


class Units(dict):
    """Ids of units as bytes. Holds the units in use, and those used before, up to REMEMBERED each, and no long ones."""

    def __init__(self, pieces: Pieces):
        self.spelt, self.older = pieces.spelt, {}

    def __missing__(self, unit: str) -> bytes:
        code = self.older.get(unit)
        if code is None:
            code = self.spelt(unit)
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = code
        return code


def crossing(a: np.ndarray, b: np.ndarray, d: int) -> int:
    """How many of the first d ends on the merge path are A's; of equal ends A's goes first."""
    low, high = max(0, d - len(b)), min(d, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[d - i - 1]:
            low = i + 1
        else:
            high = i
    return low


def pieces(a: np.ndarray, b: np.ndarray, work: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlaps of each piece: the A token, the B token, and whether the stretch ends both."""
    total = len(a) + len(b)
    for d in range(0, total, work):
        i, i_stop = crossing(a, b, d), crossing(a, b, min(d + work, total))
        j, j_stop = d - i, min(d + work, total) - i_stop
        ends = np.concatenate((a[i:i_stop], b[j:j_stop]))
        ends.sort(kind="stable")  # two ascending runs: one merge
        ends = ends[np.diff(ends, prepend=-1) > 0]
        if d:  # an end of both tokens that the cut falls between belongs to the piece before
            ends = ends[ends > max(a[i - 1] if i else -1, b[j - 1] if j else -1)]
        of_a = i + np.searchsorted(a[i:i_stop], ends)
        of_b = j + np.searchsorted(b[j:j_stop], ends)
        yield of_a, of_b, (a[of_a] == ends) & (b[of_b] == ends)


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a_vocabulary: str, b_vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Letters(a_vocabulary), Pieces(b_vocabulary)
        self.n_b = len(self.b.bytes)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # Printed ids: of A before a comma or a bar, then of B before a comma or a semicolon.
        self.printed = [f"{i}{end}" for side, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side.bytes)) for end in ends]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or None where one of them does not spell a space and the text."""
        if not text:
            return None
        raw, both = (" " + text).encode(), (self.a.ids(text), self.b.ids(text))
        if any(sizes[ids].sum() != len(raw) for sizes, ids in zip(self.sizes, both, strict=True)):
            return None
        if not self.a.lossless and b"".join(map(self.a.bytes.__getitem__, both[0].tolist())) != raw:
            return None
        return both

    def groups(self, a_ids: np.ndarray, b_ids: np.ndarray, work: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Of each piece: its number of overlaps, and the ends of the groups it closes, as A and B tokens before."""
        a, b = np.cumsum(self.sizes[0][a_ids]), np.cumsum(self.sizes[1][b_ids])
        for of_a, of_b, linked in pieces(a, b, work):
            yield len(of_a), of_a[linked] + 1, of_b[linked] + 1

    def text(self, a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """The groups as `a1,a2|b1;`, ids in order; the ends count from the first of the given ids."""
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        for ids, ends, others, base in (
            (a_ids, a_ends, np.concatenate(([0], b_ends[:-1])), 0), (b_ids, b_ends, a_ends, 2 * len(self.a.bytes))):
            sizes = np.diff(ends, prepend=0)
            mine = base + 2 * ids
            mine[ends - 1] += 1
            codes[np.arange(len(ids)) + np.repeat(others, sizes)] = mine
        return "".join(map(self.printed.__getitem__, codes.tolist()))

    def aligned(self, text: str | None, work: int) -> tuple:
        """A row of PER_DOCUMENT without the id."""
        found = self.tokens(text)
        if found is None:
            return 0, 0, 0, 0, 0, "", [], []
        (a_ids, b_ids), digest, held = found, hashlib.sha256(), ""
        overlaps = groups = at_a = at_b = 0
        links = []
        for n, a_ends, b_ends in self.groups(a_ids, b_ids, work):
            overlaps += n
            if len(a_ends):  # what the pieces before left open is the beginning of the first group
                links.append(a_ids[a_ends - 1] * self.n_b + b_ids[b_ends - 1])
                digest.update(held.encode())
                held = self.text(a_ids[at_a : a_ends[-1]], b_ids[at_b : b_ends[-1]], a_ends - at_a, b_ends - at_b)
                groups, at_a, at_b = groups + len(a_ends), a_ends[-1], b_ends[-1]
        digest.update(held[:-1].encode())
        pairs, times = np.unique(np.concatenate(links), return_counts=True)
        return len(a_ids), len(b_ids), groups, int(times.sum()), overlaps, digest.hexdigest(), pairs, times


@lru_cache(maxsize=1)
def aligner_of(a_vocabulary: str, b_vocabulary: str) -> Aligner:
    """The aligner of this worker; its tasks share the pieces that it remembers."""
    return Aligner(a_vocabulary, b_vocabulary)


def aligned_documents(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, work: int = WORK, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """Counts, digest of the groups, and distinct linked id pairs with their number, of each document."""
    schema = pa.schema([(c, pa.int64()) for c in COUNTS] + [
        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_vocabulary, b_vocabulary)
        for batch in batches:
            for part in slices(batch):
                rows = [aligner.aligned(t.as_py(), work) for t in part["_text"]]
                columns = [part["_id"], *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(make, PER_DOCUMENT)


def alignment_groups(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, work: int = WORK, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The groups themselves: one row per piece that closes groups, with the ids of these groups and where each
    group ends among them. Pieces of a document follow one another; documents without tokens have no row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_vocabulary, b_vocabulary)
        for batch in batches:
            for doc_id, text in zip(batch["_id"], batch["_text"], strict=True):
                found, at_a, at_b, k = aligner.tokens(text.as_py()), 0, 0, 0
                for _, a_ends, b_ends in aligner.groups(*found, work) if found else ():
                    if len(a_ends):
                        lists = (found[0][at_a : a_ends[-1]], found[1][at_b : b_ends[-1]], a_ends - at_a, b_ends - at_b)
                        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in lists]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([doc_id.as_py()], pa.int64()), pa.array([k], pa.int32()), *lists],
                            ["doc_id", "piece", "a_ids", "b_ids", "a_ends", "b_ends"])
                        at_a, at_b, k = a_ends[-1], b_ends[-1], k + 1

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(make, GROUPS)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best of the stored documents: links of the id pair corpus-wide, and whether no pair of its B id has more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = np.concatenate((keys, batch["pairs"].flatten().to_numpy()))
            n = np.concatenate((counts, batch["times"].flatten().to_numpy()))
            keys, place = np.unique(more, return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, n)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    summed = aligned.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % n_b))
    return summed.select("pair", "n", (F.col("n") == most).alias("best"))


def weighed(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored documents with n_best and count_sum. The pairs are fewer than the bytes of both vocabularies."""
    table = pairs.toArrow().sort_by("pair")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            at = np.searchsorted(keys, batch["pairs"].flatten().to_numpy())
            times = batch["times"].flatten().to_numpy()
            stops = np.cumsum([0, *(len(x) for x in batch["pairs"])])
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * best[at], times * counts[at])]
            n_best, count_sum = (pa.array((x[stops[1:]] - x[stops[:-1]]).astype(np.int64)) for x in sums)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in COUNTS), n_best, count_sum, batch["groups_sha256"]], [*COUNTS, "n_best", "count_sum", "groups_sha256"])

    out = ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"]) + ", groups_sha256 string"
    return aligned.mapInArrow(add, out)


def alignment_table(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, work: int = WORK, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256 of each document."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_vocabulary).get_piece_size()
    found = stored(aligned_documents(docs, a_vocabulary, b_vocabulary, work, id_column, text_column))
    return weighed(found, pair_counts(found, n_b))
