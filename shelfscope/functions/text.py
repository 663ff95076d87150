"""Tokens and n-grams with in-row counts, so that counting a text needs no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.scalars import col, let

# Spark's default English stop words of two or more plain letters.
STOP_WORDS = tuple(
    """me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very can will just
    don should now cannot could ought would""".split()
)

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of two or more word characters, stop words left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def ngrams(words: Column, n_max: int) -> Column:
    """The words, then every run of 2..n_max neighbours joined by a blank."""
    def grow(w: Column) -> Column:
        parts = [w]
        run = w
        for n in range(2, n_max + 1):
            tail = F.slice(w, n, F.greatest(F.size(w) - (n - 1), F.lit(0)))
            # the shorter side pads with null, and concat with null is null
            run = F.array_compact(F.zip_with(run, tail, lambda a, b: F.concat(a, F.lit(" "), b)))
            parts.append(run)
        return F.concat(*parts)
    return let(words, grow) if n_max > 1 else words


def counted(items: Column) -> Column:
    """array<struct<term, tf>> of an array of strings, by run lengths of the sorted array."""
    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(starts, lambda st: F.transform(
            st,
            lambda p, j: F.struct(
                F.get(s, p).alias("term"),
                (F.coalesce(F.get(st, j + 1), size) - p).alias("tf"),
            ),
        ))
    return F.when(F.size(items) > 0, let(F.sort_array(items), runs)).otherwise(
        F.array().cast("array<struct<term:string,tf:int>>"))


def term_counts(text: Column | str, ngram_max: int = 2, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return let(ngrams(tokens(text, stop_words), ngram_max), counted)
