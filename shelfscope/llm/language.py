"""Language of a text, with spans for mixed text.

A word is a run of letters of one script. The script's character range narrows the
languages that come into question to those whose training text holds it. Within these, a
word scores the sum of log-probabilities of its hashed letter trigrams, with marks at its
ends. Viterbi over the words, with a penalty for each change of language, labels the
spans; the language with most letters is the text's, its share of letters the score.

The model is `buckets` log-probabilities per language: its size does not grow with the
corpus. Counts cover all training rows.

Null text or text without a letter: `und`, score 0, no span. No training row: every text
is `und`. Very long texts take memory in proportion to one text. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import slices, stored

#: First and last code point of the blocks of common scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Characters that are looked at together.
GROUP = 1 << 17
#: Script code of a letter outside these ranges.
OTHER = len(SCRIPTS) + 1


@dataclass(frozen=True)
class LanguageParameters:
    buckets: int = 1 << 16
    smoothing: float = 0.5
    switch_penalty: float = 14.0
    #: A language owns a script when this share of its training letters is in it.
    script_share: float = 0.02
    #: Languages the model may hold; beyond it, fit() is an error, since the model goes to every task.
    most_languages: int = 2000


def script_table() -> np.ndarray:
    """Script code of every code point; 0 where it is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    table = np.where(letter, OTHER, 0).astype(np.uint8)
    for code, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            table[low : high + 1][letter[low : high + 1]] = code
    return table


_table: list[np.ndarray] = []


def _scripts() -> np.ndarray:
    if not _table:
        _table.append(script_table())
    return _table[0]


def lowered(text: str) -> str:
    """Lower case with as many characters as the text has."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Letters:
    """Words and trigram buckets of texts that are looked at together; `buckets` is a power of two."""

    def __init__(self, texts: list[str], buckets: int):
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        script = _scripts()[code]
        change = np.flatnonzero(script[1:] != script[:-1]) + 1
        if script[0]:
            change = np.concatenate([[0], change])
        # Every change of script begins a word, ends one, or both.
        begins = change[script[change] > 0]
        ends = change[(change > 0) & (script[np.maximum(change, 1) - 1] > 0)]
        self.starts, self.ends, self.script = begins, ends, script[begins]
        self.lengths = ends - begins
        letters = code[script > 0]
        self.first = np.cumsum(self.lengths) - self.lengths
        # Trigrams end at each letter, and one behind the word's last; 0 marks the word's ends.
        one, two = np.zeros_like(letters), np.zeros_like(letters)
        one[1:], two[2:] = letters[:-1], letters[:-2]
        one[self.first] = two[self.first] = 0
        second = self.first[self.lengths > 1] + 1
        two[second] = 0
        last = self.first + self.lengths - 1
        self.bucket = _bucket(letters, one, two, buckets)
        self.tail = _bucket(np.zeros_like(letters[last]), letters[last], one[last], buckets)
        # Words of text k are at cuts[k]:cuts[k + 1]; offsets[k] is where the text starts.
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.cuts = np.searchsorted(self.starts, self.offsets)

    def counts(self, buckets: int) -> np.ndarray:
        """Occurrences of each bucket, then letters of each script."""
        found = np.bincount(self.bucket, minlength=buckets) + np.bincount(self.tail, minlength=buckets)
        return np.concatenate([found, np.bincount(self.script, weights=self.lengths, minlength=256).astype(np.int64)])

    def scores(self, model: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        if not len(self.starts):
            return np.zeros((0, model.shape[1]), np.float32)
        return np.add.reduceat(model[self.bucket], self.first, axis=0) + model[self.tail]


def _bucket(c: np.ndarray, b: np.ndarray, a: np.ndarray, buckets: int) -> np.ndarray:
    mixed = c * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ a * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return ((mixed >> np.uint32(12)) & np.uint32(buckets - 1)).astype(np.int32)


def fit(spark: SparkSession, rows: DataFrame, p: LanguageParameters = LanguageParameters()) -> dict:
    """Languages, log-probabilities (buckets x languages) and the scripts of each language, from rows of text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(lowered(text))
            for lang, texts in by.items():
                for some in _together(texts, GROUP):
                    n = Letters(some, p.buckets).counts(p.buckets)
                    total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    used = rows.where("lang is not null and text is not null").select("text", "lang")
    counted = used.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-counts")
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").limit(p.most_languages + 1).collect()]
    if len(languages) > p.most_languages:
        raise ValueError(f"more than {p.most_languages} languages; raise most_languages")
    # At most buckets + 256 rows per language.
    table: pd.DataFrame = counted.toPandas()
    n = np.zeros((p.buckets + 256, len(languages)))
    number = {lang: k for k, lang in enumerate(languages)}
    n[table["bucket"].to_numpy(), table["lang"].map(number).to_numpy(np.int64)] = table["n"].to_numpy()
    grams, letters = n[: p.buckets] + p.smoothing, n[p.buckets :]
    model = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    owns = letters >= p.script_share * np.maximum(letters.sum(axis=0), 1)
    return {"languages": languages, "model": model, "owns": owns & (letters > 0)}


def _together(texts: list[str], characters: int) -> Iterator[list[str]]:
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > characters:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t) + 1
    if some:
        yield some


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, when each change of language costs `penalty`."""
    n, languages = scores.shape
    scores = scores.astype(np.float64)
    best = int(scores.sum(axis=0).argmax())
    # If no run of words gains half the penalty in another language, no change can pay.
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    rise = gain[0].max() if n == 1 else max(gain[0].max(), (gain[1:] - floor[:-1]).max())
    if rise <= penalty / 2:
        return np.full(n, best)
    # Values before each word's step; lists are faster than arrays for a few languages.
    value, values = [0.0] * languages, []
    for row in scores.tolist():
        values.append(value)
        change = max(value) - penalty
        value = [(v if v >= change else change) + x for v, x in zip(value, row, strict=True)]
    path = np.empty(n, np.int64)
    at = value.index(max(value))
    for t in range(n - 1, -1, -1):
        path[t] = at
        top = max(values[t])
        if values[t][at] < top - penalty:
            at = values[t].index(top)
    return path


def label(text_scores: np.ndarray, script: np.ndarray, lengths: np.ndarray, model: dict, penalty: float) -> tuple[np.ndarray, int, float]:
    """Language of each word, of the text, and the share of letters it has."""
    owns = model["owns"][script]
    narrowed = np.where(owns | ~owns.any(axis=1, keepdims=True), text_scores, text_scores.min() - 1e3)
    path = viterbi(narrowed, penalty)
    letters = np.bincount(path, weights=lengths, minlength=len(model["languages"]))
    top = int(letters.argmax())
    return path, top, float(letters[top] / letters.sum())


def _labelled(texts: list[str], model: dict, names: list[str], p: LanguageParameters) -> list[dict]:
    found = Letters(texts, p.buckets)
    scores = found.scores(model["model"]) if names else None
    out = []
    for k in range(len(texts)):
        a, b = found.cuts[k], found.cuts[k + 1]
        if a == b or not names:
            out.append({"lang_pred": "und", "score": 0.0, "spans": []})
            continue
        path, top, share = label(scores[a:b], found.script[a:b], found.lengths[a:b], model, p.switch_penalty)
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
        at = found.offsets[k]
        spans = [
            {"start": int(found.starts[a + x] - at), "end": int(found.ends[a + y - 1] - at), "lang": names[path[x]]}
            for x, y in zip(edges[:-1], edges[1:], strict=True)
        ]
        out.append({"lang_pred": names[top], "score": share, "spans": spans})
    return out


def identify(docs: DataFrame, model: dict, p: LanguageParameters = LanguageParameters(), text: str = "text", into: str = "language") -> DataFrame:
    """The rows with a struct `into` added: lang_pred, score and spans (first and last character + 1, language)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    languages = len(model["languages"])

    shape = pa.struct([
        ("lang_pred", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))),
    ])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        names = model["languages"]
        for whole in batches:
            out = []
            for k in range(0, len(whole), 256):
                texts = [lowered(t) if t else "" for t in whole.slice(k, 256).to_pylist()]
                for some in _together(texts, max(1 << 12, GROUP * 4 // max(4, languages))):
                    out += _labelled(some, model, names, p)
            yield pa.array(out, shape)

    predict = F.arrow_udf(predict, "lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
    return docs.withColumn(into, predict(F.col(text)))


def fit_and_identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", p: LanguageParameters = LanguageParameters(),
                     into: str = "language") -> DataFrame:
    """Learns from the rows where `learn` holds and labels all of them."""
    model = fit(docs.sparkSession, docs.where(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang")), p)
    return identify(docs, model, p, text, into)
