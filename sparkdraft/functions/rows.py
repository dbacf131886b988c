"""Row shaping that evaluates costly expressions once.

Catalyst pushes a filter on a computed column below the projection that computes
it, and infers a ``size(array) > 0`` filter for an explode.  For cheap columns
that is free; for a regular expression over whole texts, or a Python function, it
means doing the work twice.  The helpers here keep such filters where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame) -> DataFrame:
    """The same rows; filters on its columns that follow are not pushed below."""
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def explode_rows(
    df: DataFrame, array: Column, *keep: str | Column, pos: str = "pos", item: str = "item"
) -> DataFrame:
    """``keep`` columns, position and element, one row per element of ``array``."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
