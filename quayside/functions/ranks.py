"""Exact ranks and medians within groups of any size, without a group in one task or its values in one buffer.

The distinct values of a group are counted, a few of them cut their range into parts, sums of the parts' counts say how many rows lie
before each, and only within a part are values put in order. A group of any share of all rows is spread over its parts;
rows that share a value are one count. The cuts depend on the values alone, not on the order in which rows arrive: a plan may
compute them more than once, and parts that differ would give wrong ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts that the range of a group's values is cut into, by so many of its values for each part.
PARTS, STRIDE, PICKS = 64, 8, 16


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls are equal; of the keys left's stay."""
    named = right.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = reduce(Column.__and__, (left[k].eqNullSafe(named[f"_of_{k}"]) for k in keys))
    return left.join(named, met, how).drop(*(f"_of_{k}" for k in keys))


def range_cuts(counts: DataFrame, by: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """by and _cuts, rising: parts - 1 values that cut each group's distinct values into about equal parts, fewer if it has fewer values; a row for each group that has any.

    Distinct values are dealt by their hash into PICKS * parts classes and the least hash of each is picked, so the same values give the same cuts in any order; a group leaves no more than that in one buffer.
    """
    hashed = counts.where(F.col(value).isNotNull()).select(*by, value, F.xxhash64(value).alias("_h"))  # no two doubles have the same
    picked = hashed.groupBy(*by, F.pmod("_h", F.lit(parts * PICKS)).alias("_deal")).agg(F.min_by(value, "_h").alias("_pick"))
    values = picked.groupBy(*by).agg(F.sort_array(F.collect_list("_pick")).alias("_values"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.floor(i * F.size("_values") / parts).cast("int")))
    return values.select(*by, F.transform(places, lambda i: F.get("_values", i)).alias("_cuts"))


def value_ranks(rows: DataFrame, by: list[str], value: str, middle: bool = False, parts: int = PARTS) -> DataFrame:
    """by, value, n (rows with it), below (rows of the group with a lesser one) and total, for each distinct value of a group; nulls are before all others.

    With middle only the values at ranks (total - 1) div 2 and total div 2, counted from 0: the parts that hold neither are left out before anything is put in order.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    # how many cuts are below a value: first of every STRIDE-th one, then of those between
    cuts = range_cuts(counts, by, value, parts).withColumn("_coarse", F.filter("_cuts", lambda c, i: i % STRIDE == STRIDE - 1))
    lesser = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    marked = matched(counts, cuts, by, "left").withColumn("_c", lesser("_coarse") * STRIDE)  # a group of nulls has no cuts
    marked = marked.withColumn("_part", F.when(F.col(value).isNull(), -1).otherwise(F.col("_c") + lesser(F.slice("_cuts", F.col("_c") + 1, STRIDE)))).drop("_cuts", "_coarse", "_c")
    upto = lambda end: F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, end))  # noqa: E731  # a row for each part of a group
    offsets = marked.groupBy(*by, "_part").agg(F.sum("n").alias("_n")).withColumns({"_before": F.coalesce(upto(-1), F.lit(0)), "total": upto(W.unboundedFollowing)})
    if middle:
        lower, upper = ((F.col("total") - less) / 2 for less in (1, 0))
        offsets = offsets.where((F.floor(upper) >= F.col("_before")) & (F.floor(lower) < F.col("_before") + F.col("_n")))
    placed = matched(marked, offsets.drop("_n"), [*by, "_part"])
    local = F.sum("n").over(W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranked = placed.withColumn("below", F.col("_before") + F.coalesce(local, F.lit(0))).select(*by, value, "n", "below", "total")
    if middle:
        at = lambda less: F.floor((F.col("total") - less) / 2).between(F.col("below"), F.col("below") + F.col("n") - 1)
        ranked = ranked.where(at(1) | at(0))
    return ranked


def medians(rows: DataFrame, by: list[str], value: str, upper: bool = False, name: str = "median") -> DataFrame:
    """The exact median of each group's values that aren't null: the mean of the two in the middle, or the upper one of them."""
    found = value_ranks(rows.where(F.col(value).isNotNull()), by, value, middle=True)
    return found.groupBy(*by).agg((F.max(value) if upper else (F.min(value) + F.max(value)) / 2).alias(name))
