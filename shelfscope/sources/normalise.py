"""One schema for report tables that arrive with aliased or missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted spellings, the canonical name first.
ALIASES = {
    "release_year": ("release_year", "year", "releaseyear"),
    "is_free": ("is_free", "isfree"),
    "required_age": ("required_age", "requiredage"),
    "price": ("price",),
    "name": ("name", "game_name", "title"),
}
UNKNOWN_NAME = "Unknown Game"


def normalise_schema(df: DataFrame, null_year: str = "drop") -> DataFrame:
    """Canonical columns with numbers coerced; other columns pass through.

    ``null_year`` says what an unreadable year does to its row: 'drop' removes it,
    'zero' keeps it with year 0.
    """
    if null_year not in ("drop", "zero"):
        raise ValueError(f"null_year must be 'drop' or 'zero', not {null_year!r}")
    present = set(df.columns)
    source = {name: next((a for a in spellings if a in present), None)
              for name, spellings in ALIASES.items()}

    def number(name: str, as_type: str):
        raw = source[name]
        value = F.lit(0.0) if raw is None else F.coalesce(F.col(raw).try_cast("double"), F.lit(0.0))
        return value.cast(as_type).alias(name)

    out = [F.col(c) for c in df.columns if c not in {n for names in ALIASES.values() for n in names}]
    out.append((F.lit(UNKNOWN_NAME) if source["name"] is None else F.col(source["name"])).alias("name"))
    out += [number("price", "double"), number("is_free", "int"), number("required_age", "int")]
    year = source["release_year"]
    rows = df
    if year is not None:
        parsed = F.col(year).try_cast("double")
        if null_year == "drop":
            rows = df.where(parsed.isNotNull())
        out.append(F.coalesce(parsed, F.lit(0.0)).cast("int").alias("release_year"))
    return rows.select(*out)
