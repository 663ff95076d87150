"""Scalar expressions over catalog columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The release-date spellings met in raw catalogs, tried in order.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "d MMM, yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "MMM yyyy", "yyyy",
)

_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
_BARE_NONE = r"(?<=[\[,:]\s{0,4})None(?=\s{0,4}[,\]}])"
_LAST_COMMA = r",\s*([\]}])\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times
    and it is still computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- numbers ---------------------------------------------------------------

def to_number(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def clip(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bounded value; a null stays null (greatest and least would skip it)."""
    bounded = value = col(c)
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


def positive_ratio(positive: Column | str, total: Column | str) -> Column:
    return F.coalesce(F.try_divide(col(positive).cast("double"), col(total).cast("double")), F.lit(0.0))


def total_reviews(positive: Column | str, negative: Column | str) -> Column:
    return F.coalesce(col(positive), F.lit(0)) + F.coalesce(col(negative), F.lit(0))


def wilson_lower_bound(positive: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval for ``positive`` successes of ``total``."""
    n = col(total).cast("double")
    share = F.coalesce(col(positive), F.lit(0)).cast("double") / n
    z2 = F.lit(z * z)
    spread = F.lit(z) * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    bound = (share + z2 / (2 * n) - spread) / (1 + z2 / n)
    return F.when(n > 0, bound).otherwise(F.lit(0.0))


# --- owner ranges ----------------------------------------------------------

def _range_part(c: Column | str, i: int) -> Column:
    return F.trim(F.get(F.split(F.translate(col(c), ",", ""), "-"), F.lit(i))).try_cast("double")


def owners_lower(c: Column | str) -> Column:
    return _range_part(c, 0)


def owners_mid(c: Column | str, floor: float = 10_000.0) -> Column:
    two = F.size(F.split(col(c), "-")) == 2
    mid = F.when(two, (_range_part(c, 0) + _range_part(c, 1)) / 2)
    return F.greatest(F.coalesce(mid, F.lit(floor)), F.lit(floor))


# --- dates -----------------------------------------------------------------

def parse_release_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def calendar(date: Column | str) -> dict[str, Column]:
    d = col(date)
    angle = F.month(d) * F.lit(2 * math.pi) / 12
    return {
        "release_year": F.year(d),
        "release_month": F.month(d),
        "release_dow": F.weekday(d),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "is_q4_release": F.quarter(d).eqNullSafe(4).cast("int"),
    }


def repair_year(c: Column | str) -> Column:
    """Negative years count back from 2013, two-digit years belong to 2000; text gives null."""
    y = col(c).try_cast("double").cast("int")
    return F.when(y < 0, F.lit(2013) - y).when(y < 100, y + 2000).otherwise(y)


# --- list literals ---------------------------------------------------------

def _parsed(text: Column, schema: str) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(text, _LAST_COMMA, "$1"), _BARE_NONE, "null")
    return F.coalesce(F.from_json(text, schema, _JSON_OPTIONS), F.from_json(tidy, schema, _JSON_OPTIONS))


def parse_list(c: Column | str) -> Column:
    """Items of a list literal, keys of a dict literal, and an empty array otherwise."""
    text = F.trim(col(c).cast("string"))
    keys = F.array_distinct(F.map_keys(_parsed(text, "map<string,string>")))
    items = _parsed(text, "array<string>")
    parsed = F.when(F.startswith(text, F.lit("{")), keys).when(F.startswith(text, F.lit("[")), items)
    return F.coalesce(parsed, F.array().cast("array<string>"))


def first_or(items: Column | str, default: str) -> Column:
    return F.coalesce(F.get(col(items), F.lit(0)), F.lit(default))


#: Characters of an item that a column name holds as underscores, and its greatest length.
UNSAFE, NAME_CHARS = " -/", 30


def safe_name(c: Column | str) -> Column:
    return F.substring(F.translate(F.lower(col(c)), UNSAFE, "_" * len(UNSAFE)), 1, NAME_CHARS)


def safe_column(item: str) -> str:
    """The same for one item on the driver."""
    return item.lower().translate(str.maketrans(UNSAFE, "_" * len(UNSAFE)))[:NAME_CHARS]


# --- text ------------------------------------------------------------------

def has_hangul(c: Column | str) -> Column:
    return col(c).rlike("[가-힣]")


def word_count(c: Column | str) -> Column:
    text = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def with_suffix(c: Column | str, suffix: str) -> Column:
    return F.concat(col(c).cast("string"), F.lit(suffix))
