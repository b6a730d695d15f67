"""Columns that are computed where they are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **made: Column) -> DataFrame:
    """`df` with columns that are computed once a row, after what `df` does: what a generator puts out is never computed
    again in place of its name, as projections are where filters (also below an aggregate) or other columns read them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
