"""Which funds pass the screen, their reasons, and the wide table that people read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.config import SCREEN_WEIGHTS
from quayside.functions.scalars import half_up
from quayside.operators.measures import alpha_sums, beaten_rate, outperformed, weighted_score


def qualified(score: Column, periods: Column, least: int = 2) -> Column:
    return F.coalesce((score > 0) & (periods >= least), F.lit(False))


def rationale(status: Column, score: Column, alphas: Mapping[str, Column]) -> Column:
    """'Qualified: +1.20 (1y up, 3y down)': the signed score or N/A and each known period's direction; without any, N/A."""
    marks = F.filter(F.array(*(F.when(a > 0, f"{p} up").when(a.isNotNull(), f"{p} down") for p, a in alphas.items())), lambda m: m.isNotNull())
    shown = F.when(score.isNotNull(), F.format_string("%+.2f", half_up(score, 2))).otherwise("N/A")
    return F.concat(status, F.lit(": "), shown, F.lit(" ("), F.when(F.size(marks) > 0, F.array_join(marks, ", ")).otherwise("N/A"), F.lit(")"))


def screen(alphas: DataFrame, weights: Mapping[str, float] = SCREEN_WEIGHTS, key: str = "fund_id") -> DataFrame:
    """fund_id, weighted_alpha, total_periods, out_periods, rate, qualified: all of a fund's figures come from one aggregation."""
    sums = alphas.groupBy(key).agg(*alpha_sums(weights), *outperformed())
    score = weighted_score(2)
    return sums.select(key, score.alias("weighted_alpha"), "total_periods", "out_periods", beaten_rate("known").alias("rate"), qualified(score, F.col("total_periods")).alias("qualified"))


def bucket_pivot(entries: DataFrame, key: str, label: str, amount: str, buckets: Mapping[str, str], names: Sequence[str], rest: str = "Other") -> DataFrame:
    """One row per key, one column per bucket: labels are mapped, unknown ones go to rest, sums have 1 digit; the names are given, so no job looks for them.

    buckets is a table of labels, so its size is bounded by what was passed in.
    """
    mapped = F.coalesce(F.get(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in buckets.items())), lambda e: e["k"] == F.col(label)), F.lit(0))["v"], F.lit(rest)) if buckets else F.lit(rest)
    wide = entries.withColumn("bucket", mapped).groupBy(key).pivot("bucket", [*names, rest]).agg(F.sum(amount))
    return wide.select(key, *(half_up(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)), 1).alias(n) for n in [*names, rest]))


def ranked_order(rows: DataFrame, types: Sequence[str] = (), tie: str = "fund_id", span: int = 1 << 16) -> DataFrame:
    """Adds position: qualified first, types in the order given (others last), then weighted_alpha and alpha_3y falling, a missing one as 0, then tie; for tables of any size.

    A window without a partition puts all rows into one task. Here rows are numbered within
    steps of a tenth of the score, and each step starts after the sum of those before it:
    only a count for each step, bounded by the range of scores, is ordered in one task. Rows whose two scores are both missing
    or 0 may be very many; they differ in tie only, so, if that is a whole number, each span of it is a step of its own.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, types)), F.col("fund_type")), F.lit(0)), F.lit(9)) if types else F.lit(0)
    fall, second = (-F.coalesce(F.col(c), F.lit(0.0)) + 0.0 for c in ("weighted_alpha", "alpha_3y"))
    side = F.when(fall == 0, F.signum(second).cast("int") + 1).otherwise(F.when(fall < 0, 0).otherwise(2))
    whole = rows.schema[tie].dataType.typeName() in ("byte", "short", "integer", "long")
    apart = F.when((fall == 0) & (second == 0), F.floor(F.col(tie) / span)).otherwise(0) if whole else F.lit(0)
    keyed = rows.withColumns({"_q": (~F.col("qualified")).cast("int"), "_t": rank, "_a": fall, "_b": second, "_s": F.floor(fall * 10), "_e": side, "_z": apart})
    steps = ["_q", "_t", "_s", "_e", "_z"]
    before = F.sum("_n").over(W.orderBy(*steps).rowsBetween(W.unboundedPreceding, -1))
    starts = keyed.groupBy(*steps).agg(F.count(F.lit(1)).alias("_n")).select(*steps, F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy(*steps).orderBy("_a", "_b", tie))
    return keyed.withColumn("_i", nth).join(starts, steps).select(*rows.columns, (F.col("_start") + F.col("_i")).alias("position"))
