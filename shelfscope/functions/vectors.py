"""Dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.functions.scalars import col, let


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector scaled to length one; a zero vector is left as it is."""
    return let(l2_norm(v), lambda n: F.transform(
        col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
