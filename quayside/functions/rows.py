"""Columns that are computed once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **made: Column) -> DataFrame:
    """df.withColumns(made), with each of made computed once.

    Plain projections that follow each other become one, in which an array that is used several times, above all
    within transform() or filter(), is written out and computed each time. inline() of one struct keeps its place.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))
