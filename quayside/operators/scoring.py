"""Scores of funds for clients. Percentiles depend on the funds that a client may hold, and there are few such universes; so they are computed once for each."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.config import MEASURES, PROFILES
from quayside.functions.ranks import matched, value_ranks
from quayside.functions.scalars import half_up, piecewise
from quayside.operators.measures import return_ratio


def profile_value(profile: Column, part: int | tuple[int, int], profiles: Mapping[str, tuple] = PROFILES) -> Column:
    """A number of a client's profile: a map literal of the few profiles."""
    get = lambda row: row[part] if isinstance(part, int) else row[part[0]][part[1]]
    out = F.lit(None).cast("double")
    for name, row in profiles.items():
        out = F.when(profile == name, F.lit(float(get(row)))).otherwise(out)
    return out


def with_defaults(clients: DataFrame, profiles: Mapping[str, tuple] = PROFILES) -> DataFrame:
    """Adds mid (the profile's middle target), target (the client's, else mid), ceiling, cap, and warning where the target is over the profile's highest."""
    mid = profile_value(F.col("profile"), 0, profiles)
    target = F.coalesce(F.col("target_pct").cast("double"), mid)
    high = profile_value(F.col("profile"), 1, profiles)
    warning = F.when(target > high, F.concat(F.lit("target "), F.format_string("%.1f", target), F.lit(" is over "), F.format_string("%.1f", high)))
    return clients.withColumns({"mid": mid, "target": target, "ceiling": profile_value(F.col("profile"), 2, profiles).cast("int"), "cap": profile_value(F.col("profile"), 3, profiles), "warning": warning})


def profile_weights(clients: DataFrame, profiles: Mapping[str, tuple] = PROFILES) -> DataFrame:
    """Adds w_alpha, w_returnfit, w_efficiency, w_momentum: the profile's, moved by how far the target is from the middle, held to 5..50 and brought to 100."""
    rows = with_defaults(clients, profiles)
    stretch = (F.col("target") - F.col("mid")) / F.col("mid")
    move = F.when(stretch > 0, F.least(F.lit(10.0), 10 * stretch)).otherwise(-F.least(F.lit(5.0), -5 * stretch))
    raw = {m: profile_value(F.col("profile"), (4, i), profiles) for i, m in enumerate(MEASURES)}
    raw["alpha"], raw["returnfit"] = raw["alpha"] - move, raw["returnfit"] + move
    rows = rows.withColumns({f"r_{m}": F.least(F.greatest(c, F.lit(5.0)), F.lit(50.0)) for m, c in raw.items()})
    total = sum((F.col(f"r_{m}") for m in MEASURES[1:]), F.col(f"r_{MEASURES[0]}"))
    return rows.withColumns({f"w_{m}": half_up(F.col(f"r_{m}") / total * 100, 2) for m in MEASURES}).drop(*(f"r_{m}" for m in MEASURES))


def universes(clients: DataFrame, funds: DataFrame) -> DataFrame:
    """(ceiling, preference) of the clients that there are, joined to the funds each admits: not too risky, and of the wanted kind where there is a wish.

    A fund answers to two wishes, none and its own kind, so wishes are an equi-join and only the ceiling is compared. The
    distinct pairs are as few as ceilings times three, but nothing depends on that: the join's kind is chosen by their size.
    """
    wish = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
    kinds = clients.select("ceiling", "preference", wish("preference").alias("_wish")).distinct()
    answers = funds.select("*", F.explode(F.array_distinct(F.array(F.lit(-1), wish("screened")))).alias("_answer"))
    return answers.join(kinds, (F.col("_answer") == F.col("_wish")) & (F.col("risk_level") <= F.col("ceiling"))).drop("_answer", "_wish")


def class_percentiles(members: DataFrame, by: list[str], columns: Mapping[str, str]) -> DataFrame:
    """Adds a percentile for each of columns (new name: column) within by: the share of the others below, in percent with 1 digit; equal ones share it, and one alone has 100.

    No class is gathered: values are ranked by value_ranks() and joined back by an equi-join, in which adaptive execution can split the rows of a class or a value.
    """
    out = members
    for name, column in columns.items():
        ranks = value_ranks(members, by, column)  # of the plain rows, so that no column waits for another
        share = F.when(F.col("total") == 1, 100.0).otherwise(half_up(100 * (F.col("below") / (F.col("total") - 1)), 1))
        out = matched(out, ranks.select(*by, column, share.alias(name)), [*by, column])
    return out


def all_negative(members: DataFrame, by: list[str], value: str = "blended") -> DataFrame:
    """by and all_negative: whether a group has values and all of them are below 0; a row for each group."""
    return members.groupBy(*by).agg((F.max(value) < 0).alias("all_negative"))


def scores(clients: DataFrame, funds: DataFrame) -> DataFrame:
    """client_id, fund_id, class, the four measures and composite, for clients (client_id, profile, target_pct, preference) and funds
    (fund_id, class, risk_level, screened, alpha, blended, efficiency, momentum).

    Alpha and efficiency are percentiles of the class within the client's universe; where all blended
    returns of a class are negative, so is everyone's fit: 0. The clients, grouped by universe, meet its members by an equi-join.
    """
    weighted = profile_weights(clients)
    by = ["ceiling", "preference", "class"]
    everyone = universes(weighted, funds)
    members = class_percentiles(everyone, by, {"alpha_n": "alpha", "efficiency_n": "efficiency"})
    members = matched(members, all_negative(everyone, by), by)
    members = members.select("fund_id", "class", "ceiling", F.col("preference").alias("wish"), "alpha_n", "efficiency_n", F.col("momentum").alias("momentum_n"), "blended", "all_negative")
    met = weighted.join(members.withColumnRenamed("ceiling", "own_ceiling"), (F.col("ceiling") == F.col("own_ceiling")) & F.col("preference").eqNullSafe(F.col("wish")))
    fit = F.when(F.col("all_negative"), 0.0).otherwise(piecewise(return_ratio(F.col("blended"), F.col("target"))))
    met = met.withColumn("returnfit_n", fit)
    dot = sum((F.col(f"w_{m}") * F.col(f"{m}_n") for m in MEASURES[1:]), F.col("w_alpha") * F.col("alpha_n"))
    return met.select("client_id", "fund_id", "class", "profile", *(f"{m}_n" for m in MEASURES), half_up(dot / 100, 2).alias("composite"))


def ranked(scored: DataFrame, tie: str = "fund_id") -> DataFrame:
    """Adds position by composite, alpha_n and efficiency_n, all falling, then tie: an order that holds for any set."""
    return scored.withColumn("position", F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("composite"), F.desc("alpha_n"), F.desc("efficiency_n"), tie)))


def best_of(scored: DataFrame, k: int, tie: str = "fund_id") -> DataFrame:
    """The first k of ranked(): Spark cuts each task's rows to k of a client before they are shuffled."""
    return ranked(scored, tie).where(F.col("position") <= k)


def ranked_bands(scored: DataFrame, width: float = 2.0, tie: str = "fund_id", by: str = "client_id") -> DataFrame:
    """Adds band and position: composites, falling, are in one band while each is within width of the one before; within a band alpha_n and efficiency_n decide, both falling, then tie.

    Bands are an order for any set of rows, whatever their order, unlike a comparison of pairs; see ranked_banded(). Two windows over the same partitioning: one shuffle.
    """
    w = W.partitionBy(by)
    sweep = w.orderBy(F.desc("composite"), tie)
    opens = F.coalesce((F.lag("composite").over(sweep) - F.col("composite") > width).cast("int"), F.lit(0))
    banded = scored.withColumn("_opens", opens).withColumn("band", (F.sum("_opens").over(sweep.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("int")).drop("_opens")
    return banded.withColumn("position", F.row_number().over(w.orderBy("band", F.desc("alpha_n"), F.desc("efficiency_n"), tie)))


def ranked_banded(scored: DataFrame, width: float = 2.0, schema: str = "client_id long, fund_id long, composite double, alpha_n double, efficiency_n double, position int", batch: int = 50_000) -> DataFrame:
    """The option for parity with pairwise comparison: position where composites within width count as equal, and alpha_n and efficiency_n decide. Not transitive, so it depends on the order of comparison: rows are taken by fund_id and
    sorted by Python's own sort, which needs all funds of a client. They come and go in batches; between these a client's funds are columns of numbers (alpha_n and efficiency_n as places among their distinct values) and a list of
    places, about 85 bytes for each fund as measured, and nothing of a client stays when the next one comes."""
    columns = ["client_id", "fund_id", "composite", "alpha_n", "efficiency_n"]

    def order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        ids, held = [], {c: array("d") for c in columns[2:]}
        for part in parts:
            client = part["client_id"].iloc[0]
            ids.append(part["fund_id"].to_numpy(copy=True))  # a view would keep the whole batch
            for c in held:
                held[c].frombytes(part[c].to_numpy(dtype=float).tobytes())
        found = {"fund_id": np.concatenate(ids)} | {c: np.frombuffer(held.pop(c)) for c in columns[2:]}
        del ids
        if (found["fund_id"][1:] < found["fund_id"][:-1]).any():
            by_fund = np.argsort(found["fund_id"], kind="stable")
            for c in found:
                found[c] = found[c][by_fund]
            del by_fund
        distinct = {c: np.unique(found[c]) for c in columns[3:]}
        distinct = {c: v for c, v in distinct.items() if np.isfinite(v).all()}  # others don't compare as their places do
        for c, v in distinct.items():
            low = np.empty(len(found[c]), np.min_scalar_type(len(v)))
            for start in range(0, len(low), batch):
                low[start : start + batch] = np.searchsorted(v, found[c][start : start + batch])
            found[c] = low
        composite, alpha, efficiency = (memoryview(found[c]) for c in columns[2:])

        class Place(int):
            """A fund's place in the columns; sorted by what these hold."""

            __slots__ = ()

            def __lt__(self, other: int) -> bool:
                gap = composite[other] - composite[self]
                return (gap if abs(gap) > width else alpha[other] - alpha[self] or efficiency[other] - efficiency[self]) < 0

        places = [Place(i) for i in range(len(composite))]
        places.sort()
        for start in range(0, len(places), batch):
            at = np.fromiter(places[start : start + batch], dtype=np.int64)
            rows = {c: distinct[c][found[c][at]] if c in distinct else found[c][at] for c in columns[1:]}
            yield pd.DataFrame({"client_id": client} | rows | {"position": np.arange(start + 1, start + 1 + len(at))})
        composite = alpha = efficiency = None  # a class lives until the garbage collector comes by, and with it what its methods read

    return scored.select(*columns).groupBy("client_id").applyInPandas(order, schema)
