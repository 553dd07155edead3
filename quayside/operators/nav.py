"""Price histories: all-time highs, drawdowns, and their upkeep from new points only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.ranks import medians
from quayside.functions.scalars import half_up

KEY, WHEN, NAV = "fund_id", "nav_date", "nav"
STATE = "fund_id long, ath_nav double, ath_date date, current_nav double, current_date date, data_from date, points long"
#: Days of a fund that have a point: bit i of days in chunk c is the day 64 c + i since 1970.
DAYS = "fund_id long, chunk int, days long"


def all_time_high(points: DataFrame) -> DataFrame:
    """For each fund of points (fund_id, nav_date, nav): highest price and the first day that had it, last price and day, first day, number of points.

    One shuffle, with partial aggregates. Points without a price count but are
    never the highest; equal days keep the highest price. A fund with no price at
    all has nulls.
    """
    top = F.max(F.when(F.col(NAV).isNotNull(), F.struct(F.col(NAV).alias("nav"), (-F.unix_date(WHEN)).alias("before")))).alias("top")
    last = F.max(F.when(F.col(NAV).isNotNull(), F.struct(F.col(WHEN).alias("day"), F.col(NAV).alias("nav")))).alias("last")
    out = points.groupBy(KEY).agg(top, last, F.min(WHEN).alias("data_from"), F.count(F.lit(1)).alias("points"))
    return out.select(KEY, F.col("top.nav").alias("ath_nav"), F.date_from_unix_date(-F.col("top.before")).alias("ath_date"), F.col("last.nav").alias("current_nav"), F.col("last.day").alias("current_date"), "data_from", "points")


def drawdown(state: DataFrame, as_of: Column) -> DataFrame:
    """Adds drawdown_pct (2 digits, null where the high isn't positive) and days_from_ath; prices get 4 digits. as_of is given, so a run can be repeated."""
    pct = F.when(F.col("ath_nav") > 0, half_up((F.col("current_nav") - F.col("ath_nav")) / F.col("ath_nav") * 100, 2))
    return state.withColumns({"drawdown_pct": pct, "days_from_ath": F.datediff(as_of, "ath_date"), "ath_nav": half_up("ath_nav", 4), "current_nav": half_up("current_nav", 4)})


def new_points(points: DataFrame, state: DataFrame, through: str = "current_date") -> DataFrame:
    """The points of each fund after the last day in its state; all points of funds without one. Late corrections stay out, as in any refresh of this kind."""
    seen = state.select(F.col(KEY).alias("own_key"), F.col(through).alias("seen"))
    return points.join(seen, points[KEY] == F.col("own_key"), "left").where(F.col("seen").isNull() | (F.col(WHEN) > F.col("seen"))).select(*points.columns)


def halves(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state up to the middle between the first and the last day of all points, and the points after it. Each point is in one of them; those without a day are in the state."""
    day = F.broadcast(points.agg(F.min(WHEN).alias("first"), F.max(WHEN).alias("last")).select(F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int")).alias("middle")))
    old = all_time_high(points.crossJoin(day).where(F.coalesce(F.col(WHEN) <= F.col("middle"), F.lit(True))).select(*points.columns))
    # a fund's last price may be before its last point, so the middle says what has been seen
    return old, new_points(points, old.crossJoin(day), "middle")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two states as one: the greater high (of equal ones the earlier day), the later price (of a day the greater), counts added. Funds on one side stay. The merge is associative and the
    order of the two doesn't matter, so states of any split of a history give that of the whole. Where parts may overlap, counted() gives the points."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{KEY}") == F.col(f"b.{KEY}"), "full_outer")
    rises = F.col("a.ath_nav").isNull() | (F.struct("b.ath_nav", -F.unix_date("b.ath_date")) > F.struct("a.ath_nav", -F.unix_date("a.ath_date")))
    newer = F.col("a.current_date").isNull() | (F.struct("b.current_date", "b.current_nav") > F.struct("a.current_date", "a.current_nav"))
    pick = lambda test, c: F.when(test & F.col("b.ath_nav").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(
        F.coalesce(f"a.{KEY}", f"b.{KEY}").alias(KEY), pick(rises, "ath_nav"), pick(rises, "ath_date"), pick(newer, "current_nav"), pick(newer, "current_date"),
        F.least("a.data_from", "b.data_from").alias("data_from"), (F.coalesce("a.points", F.lit(0)) + F.coalesce("b.points", F.lit(0))).alias("points"),
    )


def day_sets(points: DataFrame) -> DataFrame:
    """The days of each fund that have a point, as sets of 64 days in a long; points without a day have none. Partial sets are made where the points lie."""
    day = F.unix_date(WHEN)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(64)))
    rows = points.where(F.col(WHEN).isNotNull()).select(KEY, F.floor(day / 64).cast("int").alias("chunk"), bit.alias("days"))
    return rows.groupBy(KEY, "chunk").agg(F.bit_or("days").alias("days"))


def merged_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two tables of day sets: the same whatever comes again, and in any order."""
    return old.unionByName(new).groupBy(KEY, "chunk").agg(F.bit_or("days").alias("days"))


def counted(state: DataFrame, days: DataFrame) -> DataFrame:
    """state with points as the number of distinct days in days."""
    n = days.groupBy(KEY).agg(F.sum(F.bit_count("days")).cast("long").alias("_n"))
    return state.join(n, KEY, "left").withColumn("points", F.coalesce("_n", F.lit(0)).cast("long")).select(*state.columns)


def drawdown_summary(state: DataFrame, recent: int = 30) -> DataFrame:
    """One row: funds by depth of drawdown, how many are at or near their high, and the upper median."""
    d = F.col("drawdown_pct")
    counts = state.groupBy(F.lit(0).alias("_all")).agg(
        F.count_if(d >= -1).alias("at_high"), F.count_if((d >= -10) & (d < -1)).alias("shallow"), F.count_if((d >= -20) & (d < -10)).alias("middling"), F.count_if(d < -20).alias("deep"),
        F.count_if(F.col("days_from_ath") == 0).alias("today"), F.count_if(F.col("days_from_ath") <= recent).alias("recent"),
    )
    nothing = state.sparkSession.createDataFrame([(0,)], "_all int")  # an empty state still gives its row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns[1:]]
    return nothing.join(counts, "_all", "left").join(upper_median(state.withColumn("_all", F.lit(0)), "drawdown_pct", ["_all"]), "_all", "left").select(*zero, "upper_median")


def recent_highs(state: DataFrame, days: int = 30) -> DataFrame:
    """fund_id, ath_date and days_from_ath of the funds whose high is of today or not older than days."""
    return state.where(F.col("days_from_ath") <= days).select(KEY, "ath_date", "days_from_ath")


def upper_median(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The element at n // 2, counted from 0, of each group's sorted values without nulls; exact, and no group's values are gathered."""
    return medians(values, by, column, upper=True, name="upper_median")
