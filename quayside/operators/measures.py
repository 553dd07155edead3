"""Returns against a benchmark: alphas, weighted blends, efficiency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config import SCORE_WEIGHTS, SCREEN_WEIGHTS
from quayside.functions.scalars import half_up


def weight_of(period: Column, weights: Mapping[str, float]) -> Column:
    """A period's weight, null for others; a map literal, so there is no join."""
    return F.get(F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in weights.items())), lambda e: e["p"] == period), F.lit(0))["w"]


def period_alpha(returns: DataFrame) -> DataFrame:
    """Adds alpha (2 digits) and beat to returns (fund_id, period, fund_ret, bench_ret); a null on either side gives nulls."""
    alpha = half_up(F.col("fund_ret") - F.col("bench_ret"), 2)
    return returns.withColumn("alpha", alpha).withColumn("beat", F.col("fund_ret") > F.col("bench_ret"))


def outperformed() -> list[Column]:
    """Aggregates out_periods and known: periods beaten and periods known."""
    return [F.count_if(F.col("beat")).alias("out_periods"), F.count("alpha").alias("known")]


def beaten_rate(known: str = "total_periods") -> Column:
    return F.when(F.col(known) > 0, half_up(F.col("out_periods") / F.col(known) * 100, 1)).otherwise(0.0)


def outperformance(alphas: DataFrame, key: str = "fund_id") -> DataFrame:
    """For each fund: periods beaten, periods known, and their rate in percent (0 if none is known)."""
    out = alphas.groupBy(key).agg(*outperformed()).withColumnRenamed("known", "total_periods")
    return out.withColumn("rate", beaten_rate())


def alpha_sums(weights: Mapping[str, float] = SCREEN_WEIGHTS) -> list[Column]:
    """Aggregates dot, weight and total_periods over the periods that are known and have a weight."""
    w = F.when(F.col("alpha").isNotNull(), weight_of(F.col("period"), weights))
    return [F.sum((w * F.col("alpha")).cast("decimal(28,6)")).alias("dot"), F.sum(w.cast("decimal(18,4)")).alias("weight"), F.count(w).alias("total_periods")]


def weighted_score(least: int) -> Column:
    return F.when(F.col("total_periods") >= least, half_up(F.col("dot").cast("double") / F.col("weight").cast("double"), 4))


def weighted_alpha(alphas: DataFrame, weights: Mapping[str, float] = SCREEN_WEIGHTS, least: int = 2, key: str = "fund_id") -> DataFrame:
    """fund, weighted_alpha (4 digits, weights renormalised over known periods; null if fewer than least) and total_periods."""
    return alphas.groupBy(key).agg(*alpha_sums(weights)).select(key, weighted_score(least).alias("weighted_alpha"), "total_periods")


def blend(periods: Mapping[str, Column], weights: Mapping[str, float] = SCORE_WEIGHTS) -> Column:
    """Weighted mean of columns by period over those that aren't null, 4 digits; 0 if all are. One row at a time, no shuffle."""
    dot, total = F.lit(0.0), F.lit(0.0)
    for p, w in weights.items():
        if p in periods:
            dot = dot + F.coalesce(periods[p] * w, F.lit(0.0))
            total = total + F.when(periods[p].isNotNull(), w).otherwise(0.0)
    return F.when(total > 0, half_up(dot / total, 4)).otherwise(0.0)


def penalised(value: Column, three: Column, five: Column) -> Column:
    """Halved if the 3-year alpha is negative and again if the 5-year one is; null is no reason."""
    half = lambda c: F.when(c < 0, 0.5).otherwise(1.0)
    return value * half(three) * half(five) + 0.0  # no negative zero


def efficiency(alpha: Column, volatility: Column) -> Column:
    """Alpha for each unit of volatility; null where either is missing or volatility is 0."""
    return F.try_divide(alpha, F.nullif(volatility, F.lit(0.0)))


def efficiency_pick(three: Column, one: Column) -> Column:
    return F.coalesce(three, one, F.lit(0.0))


def return_ratio(blended: Column, target: Column) -> Column:
    return F.coalesce(F.try_divide(blended, F.nullif(target, F.lit(0.0))), F.lit(0.0))
