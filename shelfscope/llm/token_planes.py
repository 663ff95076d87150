"""Token ids in binary files of byte or bit planes.

Documents are dealt by range over their ids; each task encodes its texts in order and
writes one shard. A shard holds blocks of `block` ids. A block of 32-bit ids is
transposed into 4 byte planes or 32 bit planes, and each plane is compressed on its own:
the high planes are nearly constant, the low ones keep the entropy. The end of a shard
is its chunk index: where each block starts, its ids, the length of its planes, and the
documents with their token counts. Layout of a shard::

    b"PLN1" | planes of block 0 | planes of block 1 | ... | doc index (zstd) | JSON | length of JSON (8 bytes) | b"PLN1"

A task writes under a name of its own and returns that name; only names that reach the
stored manifest count, so a repeated task leaves an unread file, never a wrong one.
Files go through pyarrow's file systems, by the URI of the shared folder.

Null text: an empty one, which gives the end id only. Null ids come last. Repeated ids:
each row is a document, in the order of its text. Empty table: no shard and no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.common import fresh_folder, rows_per_batch, stored

MAGIC = b"PLN1"
BLOCK = 1 << 16
#: Texts with more characters are encoded in parts.
TOGETHER = 1 << 20
#: Pieces whose ids a worker remembers, twice: those in use and those used before.
REMEMBERED = 360_000
MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_bytes long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Texts of these characters only are cut by `pieces`; tables of other characters differ between libraries.
PLAIN = [(0x0, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC)]


def pieces() -> tuple[re.Pattern, re.Pattern]:
    """What a plain text matches as a whole, and the pieces the byte-level pre-tokeniser cuts it into:
    contractions, runs of letters, of numbers or of other characters with a blank before them, white space."""
    chars = [chr(c) for low, high in PLAIN for c in range(low, high + 1)]
    one_of = lambda keep: "".join(re.escape(c) for c in chars if keep(c))
    letters = one_of(lambda c: unicodedata.category(c)[0] == "L")
    numbers = one_of(lambda c: unicodedata.category(c)[0] == "N")
    blanks = one_of(lambda c: c in "\t\n\x0b\x0c\r\x85" or unicodedata.category(c)[0] == "Z")
    cut = (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+"
        f"|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )
    return re.compile(f"[{one_of(lambda c: True)}]*"), re.compile(cut)


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others for the characters from 256 on, in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class Codes(dict):
    """Ids of pieces as bytes. Holds the pieces in use, and those used before, up to `remembered` each."""

    def __init__(self, model, remembered: int):
        self.tokenize, self.letters, self.older, self.remembered = model.tokenize, byte_letters(), {}, remembered

    def __missing__(self, piece: str) -> bytes:
        code = self.older.get(piece)
        if code is None:
            raw = piece.encode().decode("latin-1").translate(self.letters)
            code = array("I", [t.id for t in self.tokenize(raw)]).tobytes()
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[piece] = code
        return code


class PieceEncoder:
    """Byte-pair ids of texts; the pieces before byte pairing are independent, so their ids are remembered."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.plain, self.find = pieces()
        # Added tokens are cut out before the pieces. Those that take blanks or look at their neighbours are left to the tokenizer.
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added = {c: array("I", [i]).tobytes() for c, (i, _) in added.items()}
        self.literal = all(not (t.lstrip or t.rstrip or t.single_word) for _, t in added.values())
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.code = Codes(self.tokenizer.model, remembered).__getitem__

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, in parts of bounded size; a text of other characters is one part."""
        if self.cut is None or not self.cut.search(text):
            yield from self._parts(text)
        elif not self.literal:
            yield self.whole(text)
        else:
            at = 0
            for m in self.cut.finditer(text):
                if at < m.start():
                    yield from self._parts(text[at : m.start()])
                yield self.added[m.group()]
                at = m.end()
            if at < len(text):
                yield from self._parts(text[at:])

    def _parts(self, text: str) -> Iterator[bytes]:
        if not self.plain.fullmatch(text):
            yield self.whole(text)
        elif len(text) <= TOGETHER:
            yield b"".join(map(self.code, self.find.findall(text)))
        else:
            found = self.find.finditer(text)
            while some := [m.group() for m in islice(found, 1 << 16)]:
                yield b"".join(map(self.code, some))


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """The encoder of this worker; the tasks that a worker runs one after the other share its pieces."""
    return PieceEncoder(vocabulary, remembered)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte plane k holds byte k of each id; bit plane k holds bit k of each id."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(n)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(n)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents; holds at most one block of ids and the document index."""

    def __init__(self, uri: str, kind: str, level: int, block: int):
        import zstandard

        self.uri, self.kind, self.size = uri, kind, block
        self.fs, self.path = _file_system(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.out.write(MAGIC)
        self.at, self.waiting, self.held = len(MAGIC), [], 0
        self.blocks: list = []
        self.ids, self.counts = [], []

    def add(self, doc_id: int | None, parts: Iterator[bytes]) -> None:
        n = 0
        for part in parts:
            n += len(part) // 4
            self.waiting.append(part)
            self.held += len(part) // 4
            if self.held >= self.size:
                self._flush(False)
        self.ids.append(doc_id)
        self.counts.append(n)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.size
        for k in range(0, stop, self.size):
            chunk = ids[k : min(k + self.size, stop)]
            planes = [self.pack(p) for p in to_planes(chunk, self.kind)]
            self.blocks.append([self.at, len(chunk), [len(p) for p in planes]])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.waiting, self.held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> int:
        self._flush(True)
        none = np.array([d is None for d in self.ids], np.uint8)
        known = np.array([0 if d is None else d for d in self.ids], "<i8")
        index = self.pack(none.tobytes() + known.tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(index)
        about = json.dumps({"kind": self.kind, "block": self.size, "blocks": self.blocks, "docs": len(self.ids), "index": [self.at, len(index)]}).encode()
        self.out.write(about + len(about).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.at + len(index) + len(about) + 12


def read_shard(uri: str) -> Iterator[tuple[int | None, list[bytes]]]:
    """Documents of a shard with their ids as bytes, block by block."""
    import zstandard

    fs, path = _file_system(uri)
    unpack = zstandard.ZstdDecompressor().decompress
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        n = int.from_bytes(tail[:8], "little")
        f.seek(size - 12 - n)
        about = json.loads(f.read(n))
        docs, (at, length) = about["docs"], about["index"]
        f.seek(at)
        index = unpack(f.read(length)) if docs else b""
        none = np.frombuffer(index, np.uint8, docs)
        ids = np.frombuffer(index, "<i8", docs, docs)
        counts = np.frombuffer(index, "<i8", docs, 9 * docs)
        blocks = iter(about["blocks"])
        rest = memoryview(b"")
        for k in range(docs):
            need, parts = int(counts[k]) * 4, []
            while need:
                if not rest:
                    start, n_ids, lengths = next(blocks)
                    f.seek(start)
                    planes = [unpack(f.read(x)) for x in lengths]
                    rest = memoryview(from_planes(planes, n_ids, about["kind"]).tobytes())
                parts.append(bytes(rest[:need]))
                rest = rest[need:]
                need -= len(parts[-1])
            yield (None if none[k] else int(ids[k])), parts


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_column: str = "doc_id",
                      text_column: str = "text", kind: str = "byte", level: int = 3, block: int = BLOCK,
                      remembered: int = REMEMBERED) -> DataFrame:
    """Writes the shards and returns the stored manifest, one row per shard in the order of the ids.
    `remembered`: pieces whose ids a worker holds, twice; fewer take less memory and more time."""
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for doc_id, text in zip(batch["_id"].to_pylist(), batch["_text"], strict=True):
                if writer is None:
                    encoder = encoder_of(vocabulary, remembered)
                    uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.planes"
                    writer = ShardWriter(uri, kind, level, block)
                writer.add(doc_id, (p for source in (encoder.parts(text.as_py()), [end]) for p in source))
        if writer is not None:
            n_bytes = writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "file": [uri], "n_docs": [len(writer.ids)],
                "n_tokens": [sum(writer.counts)], "n_bytes": [n_bytes],
            })

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    order = [F.col("_id").asc_nulls_last(), F.col("_text")]
    placed = rows.repartitionByRange(F.col("_id").asc_nulls_last()).sortWithinPartitions(*order)
    with rows_per_batch(docs.sparkSession, 1000):
        return stored(placed.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["first"], []
                for doc_id, parts in read_shard(row["file"]):
                    crc, n = 0, 0
                    for part in parts:
                        crc, n = zlib.crc32(part, crc), n + len(part) // 4
                    out.append((doc_id, start, n, crc))
                    start += n
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], COLUMNS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], COLUMNS)

    # One row per shard, so the window holds as many rows as the writer had tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, READ_BACK)


COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]


def token_table(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, **parameters) -> DataFrame:
    """Writes the token files of the documents and reads them back."""
    folder = folder or fresh_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, end_id, folder, **parameters))
