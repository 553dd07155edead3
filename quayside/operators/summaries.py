"""Summaries of a screened table: counts, medians and best funds by type, how complete it is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.ranks import matched, medians
from quayside.functions.scalars import half_up


def type_counts(rows: DataFrame, kind: str = "fund_type", total: str = "Total") -> DataFrame:
    """kind, qualified, beat_all (a rate of 100), screened and conventional, all of the qualified ones; and a row for their total. rows: kind, qualified, rate, screened."""
    q = F.col("qualified")
    counts = rows.rollup(kind).agg(F.count_if(q).alias("qualified"), F.count_if(q & (F.col("rate") == 100)).alias("beat_all"), F.count_if(q & F.col("screened")).alias("screened"), F.grouping(kind).alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, total).otherwise(F.col(kind)).alias(kind), "qualified", "beat_all", "screened", (F.col("qualified") - F.col("screened")).alias("conventional"))


def type_medians(rows: DataFrame, measures: Mapping[str, int], kind: str = "fund_type") -> DataFrame:
    """Exact medians of measures (column: digits) of the qualified funds of each type; blanks don't count, and a type that has only blanks has none.

    Measures are rows, so one selection serves all; see medians().
    """
    good = rows.where("qualified")
    long = good.select(kind, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))))
    found = medians(long, [kind, "measure"], "value").groupBy(kind).pivot("measure", list(measures)).agg(F.first("median"))
    return matched(good.select(kind).distinct(), found, [kind], "left").select(kind, *(half_up(F.col(m), digits).alias(m) for m, digits in measures.items()))


def top_by_type(rows: DataFrame, measures: list[str], k: int = 5, kind: str = "fund_type", key: str = "fund_id") -> DataFrame:
    """kind, measure, rank, key and value: the k best qualified funds of each type for each measure, ties by key; blanks are left out.

    Measures are rows, so one ranking serves all, and each task keeps k of a type and measure before the shuffle.
    """
    long = rows.where("qualified").select(kind, key, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))).where("value IS NOT NULL")
    rank = F.row_number().over(W.partitionBy(kind, "measure").orderBy(F.desc("value"), key))
    return long.withColumn("rank", rank).where(F.col("rank") <= k).select(kind, "measure", "rank", key, "value")


def screening_counts(rows: DataFrame, present: list[str] = ()) -> DataFrame:
    """One row: funds, qualified, disqualified, pass_rate (percent, 1 digit) and for each column of present how many funds have it (with_<column>)."""
    n, q = F.count(F.lit(1)), F.count_if("qualified")
    return rows.agg(n.alias("funds"), q.alias("qualified"), (n - q).alias("disqualified"), half_up(q / n * 100, 1).alias("pass_rate"), *(F.count(c).alias(f"with_{c}") for c in present))


def filled(df: DataFrame, column: str) -> Column:
    """Whether a list, map or text holds anything, and anything else isn't null."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    return F.coalesce(F.size(c) > 0 if kind in ("array", "map") else F.length(F.trim(c)) > 0 if kind == "string" else c.isNotNull(), F.lit(False))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total, and for each column in how many rows it holds anything."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(filled(rows, c)).alias(c) for c in columns))
