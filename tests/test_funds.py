"""Fund operators on small literal tables: one case for each rule that has a boundary, and a corrupted value for each check."""

import bisect
import datetime as dt
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside import config
from quayside.functions import ranks
from quayside.functions import scalars as S
from quayside.operators import checks, exposure, extraction, measures, nav, portfolio, scoring, screening
from quayside.sources import tables, variants
from quayside.sources.versions import Versions, kept_on_failure
from quayside.streaming import nav as stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.half_up(lit(2.675), 2), S.half_up(lit(0.125), 2), S.half_up(lit(-0.05), 1), S.half_up(lit(float("nan")), 1)) == (2.68, 0.13, -0.1, None)
    assert one(spark, *(S.band_up_to(lit(x)) for x in (4.245, 4.3, 13.595, 99.0))) == ("Very Low", "Low", "High", "Very High")
    assert one(spark, S.band_up_to(S.number(lit("n/a")))) == (None,)
    assert one(spark, *(S.piecewise(lit(x)) for x in (1.5, 1.0, 0.75, 0.0, -1.0, 2.0, 0.5, 1.25))) == (100.0, 80.0, 50.0, 0.0, 0.0, 100.0, 20.0, 90.0)
    assert one(spark, S.momentum(lit(0.0), lit(10)), S.momentum(lit(-3.0), lit(500)), S.momentum(lit(None).cast("double"), lit(None).cast("int"))) == (95.0, 70.0, 10.0)
    assert one(spark, S.derived_class(lit(60.0), lit(40.0), lit(0.0), lit(0.0)), S.derived_class(lit(None).cast("double"), lit(30.0), lit(20.0), lit(10.0)), S.derived_class(lit(50.0), lit(50.0), lit(0.0), lit(0.0))) == ("Equity-equivalent", "Defensive", "Balanced")
    assert one(spark, *(S.fund_type(lit(x)) for x in ("Fund of Funds (Equity)", "Sukuk", "Balanced Equity", "Wholesale (money)", "Wholesale", ""))) == ("Fund of Funds", "Fixed Income", "Mixed Asset / Balanced", "Money Market", "", "")
    assert one(spark, *(S.distribution(lit(x)) for x in ("No distribution", "Semi-annual", "Annual", "Incidental", "?"))) == ("None", "Semi-Annual", "Annual", "Incidental", "None")
    assert one(spark, *(S.objective_class(lit(x)) for x in ("capital growth with dividends", "liquidity", "gold", "steady income", None))) == ("Capital Growth + Income", "Income", "Capital Growth", "Income", "")
    assert one(spark, *(S.asset_class(lit(n), lit(c)) for n, c in (("A Cash Deposit", ""), ("A", "Sukuk"), ("A Balanced", None), ("A Flexi", ""), ("A Income", "Equity Malaysia"), ("A Income", "Bond"), ("A Equity", "Global"), ("A", "Fixed"), ("A", "")))) == ("Money Market", "Bond / Sukuk", "Balanced", "Mixed Asset", "Equity - Malaysia", "Bond / Fixed Income", "Equity - Foreign", "Bond / Fixed Income", "Other")
    assert one(spark, *(S.place_of(lit(x)) for x in ("Asia Pacific X", "Far East", "ASEAN Fund", "US Fund", "plain"))) == ("Asia Pacific", "Asia Pacific", "ASEAN", "United States", "Malaysia")
    assert one(spark, S.series_flag(lit("x shariah.pdf"), lit("A"), lit("B")), S.series_flag(lit("x"), lit("A"), lit("QIX"), prefixes=["QI"]), S.series_flag(lit("x"), lit("A"), lit("QIX"), lit(False), ["QI"]), S.fund_type_or(lit(""), lit("Bond / Sukuk")), S.fund_type_or(lit(None), lit(None))) == (True, True, False, "Fixed Income", "Equity")
    assert one(spark, S.structural_role(lit("G"), {"G": "structural:gold"}), S.holding_label(lit("structural:gold"), lit("Balanced"), lit("")), S.holding_label(lit("core"), lit(None), lit("Fixed  Income")), S.holding_label(lit("core"), lit("Defensive"), lit("Equity"))) == ("structural:gold", "gold", "bond", "bond")
    assert one(spark, S.output_name(lit("Zoë B."), lit("Moderately Aggressive"), lit(dt.date(2024, 1, 5)), lit("1.2"))) == ("FundProposal_ZoëB_ModeratelyAggressive_2024-01-05_v1.2",)
    assert one(spark, S.truthy(lit(" Yes ")), S.truthy(lit(None)), S.truthy(lit("no"))) == (True, False, False)
    assert one(spark, S.key_form(lit("a b C")), S.clean_name(lit(" X  Fund\x07 (new) "), ["(new)"]), S.person_name(lit("a" * 200)), S.file_part(lit("Éa_b. 9")), S.file_part(lit("__")), S.shown(lit(None).cast("double"))) == ("ABC", "X Fund", "a" * 100, "Éab9", "generic", "")
    assert one(spark, S.event_date(lit("2024-01-05")), S.event_date(lit("Q2 2026")), S.event_date(lit("2024-13-05"))) == ("05 Jan 2024", "Q2 2026", "2024-13-05")
    assert one(spark, S.foreign_region(lit("Equity Global"), ["malaysia"], ["global", "china"]), S.foreign_region(lit("Malaysia Global"), ["malaysia"], ["global"]), S.foreign_region(lit(""), ["x"], ["y"])) == (True, False, False)
    assert one(spark, S.pair_list(lit("a=1|b=2|x|a=3=4")), S.split_list(lit(" a |  | b"))) == ({"b": "2", "a": "3=4"}, ["a", "b"])


def alphas(spark, *funds):
    data = [(f, p, a) for f, ps in funds for p, a in ps.items()]
    return spark.createDataFrame(data, "fund_id string, period string, alpha double").withColumn("beat", F.col("alpha") > 0)


def test_screen(spark):
    df = alphas(spark, ("full", {"ytd": 2.0, "1y": 4.0, "3y": 6.0, "5y": -1.0, "10y": 3.0}), ("partial", {"1y": 3.0, "3y": -1.0}), ("bad", {"1y": -2.0, "3y": -4.0, "5y": 1.0}), ("single", {"3y": 9.0, "1y": None}))
    got = {r["fund_id"]: (r["weighted_alpha"], r["total_periods"], r["qualified"], r["rate"]) for r in screening.screen(df).collect()}
    assert got == {"full": (3.3, 5, True, 80.0), "partial": (0.0909, 2, True, 50.0), "bad": (-2.0625, 3, False, 33.3), "single": (None, 1, False, 100.0)}
    facts = spark.createDataFrame([(1, "B", True, 1.0, None), (2, "A", True, None, 1.0), (3, "A", False, 9.0, 9.0), (4, "A", True, 2.0, 0.0), (5, "Z", True, 9.0, 0.0)], "fund_id long, fund_type string, qualified boolean, weighted_alpha double, alpha_3y double")
    assert [r["fund_id"] for r in screening.ranked_order(facts, ["A", "B"]).orderBy("position").collect()] == [4, 2, 1, 5, 3]
    said = spark.range(1).select(screening.rationale(F.lit("Qualified"), F.lit(1.204), {"1y": F.lit(1.0), "3y": F.lit(-1.0), "5y": F.lit(None).cast("double")}), screening.rationale(F.lit("Out"), F.lit(None).cast("double"), {"1y": F.lit(None).cast("double")})).first()
    assert tuple(said) == ("Qualified: +1.20 (1y up, 3y down)", "Out: N/A (N/A)")
    entries = spark.createDataFrame([("f", "Stocks", 40.04), ("f", "Shares", 10.0), ("f", "Weird", 5.0), ("g", "Cash", 1.0)], "fund string, label string, w double")
    assert rows(screening.bucket_pivot(entries, "fund", "label", "w", {"Stocks": "Equity", "Shares": "Equity", "Cash": "Cash"}, ["Equity", "Cash"])) == [("f", 50.0, 0.0, 5.0), ("g", 0.0, 1.0, 0.0)]


def test_measures(spark):
    lit, none = F.lit, F.lit(None).cast("double")
    assert one(spark, measures.blend({"3y": lit(4.0), "1y": lit(2.0), "5y": none, "ytd": none}), measures.blend({"3y": none})) == (3.3333, 0.0)
    assert one(spark, measures.penalised(lit(4.0), lit(-1.0), lit(-1.0)), measures.penalised(lit(-4.0), lit(-1.0), none)) == (1.0, -2.0)
    assert one(spark, measures.efficiency(lit(2.0), lit(4.0)), measures.efficiency(lit(2.0), lit(0.0)), measures.efficiency_pick(lit(0.0), lit(3.0)), measures.efficiency_pick(none, none), measures.return_ratio(lit(4.0), lit(0.0))) == (0.5, None, 0.0, 0.0, 0.0)


def clients(spark, *rows):
    return spark.createDataFrame(rows, "client_id long, profile string, target_pct double, preference boolean")


def test_profiles_and_universes(spark):
    got = {r["client_id"]: r for r in scoring.profile_weights(clients(spark, (1, "Moderate", 6.0, None), (2, "Moderate", None, True), (3, "Moderate", 9.0, False), (4, "Moderate", 5.0, None))).collect()}
    assert got[2]["target"] == got[4]["target"] == 5.0 and got[3]["warning"] == "target 9.0 is over 6.0" and got[1]["warning"] is None
    assert (got[4]["w_alpha"], got[4]["w_returnfit"]) == (28.0, 40.0) and (got[1]["w_alpha"], got[1]["w_returnfit"]) == (26.0, 42.0) and got[3]["w_returnfit"] > 42
    for r in got.values():
        assert sum(r[f"w_{m}"] for m in scoring.MEASURES) == pytest.approx(100, abs=0.02)
    funds = spark.createDataFrame([("A", True, 2), ("B", False, 4), ("C", True, 3), ("D", True, None)], "fund_id string, screened boolean, risk_level int")
    seen = scoring.universes(scoring.with_defaults(clients(spark, (1, "Moderate", 6.0, None), (2, "Aggressive", 6.0, False))), funds)
    assert rows(seen, "ceiling", "fund_id") == [(3, "A"), (3, "C"), (5, "B")]
    many = spark.range(500).select((F.col("id") % 250).cast("int").alias("ceiling"), (F.col("id") >= 250).alias("preference"))
    assert scoring.universes(many, funds).select("ceiling", "preference").distinct().count() == 248 + 246  # no universe is lost: with the wish from ceiling 2 on, without it from 4 on


def test_percentiles_and_scores(spark):
    df = spark.createDataFrame([("x", v) for v in (10.0, 20.0, 30.0, 40.0, 50.0)] + [("y", 1.0), ("z", 2.0), ("z", 2.0)], "class string, v double")
    assert rows(scoring.class_percentiles(df, ["class"], {"p": "v"}), "class", "v", "p") == sorted([("x", 10.0, 0.0), ("x", 20.0, 25.0), ("x", 30.0, 50.0), ("x", 40.0, 75.0), ("x", 50.0, 100.0), ("y", 1.0, 100.0), ("z", 2.0, 0.0), ("z", 2.0, 0.0)], key=str)
    funds = spark.createDataFrame([(1, "E", 2, True, 3.0, 6.0, 0.5, 50.0), (2, "E", 2, True, 1.0, 6.0, 0.5, 50.0), (3, "F", 1, False, 1.0, -2.0, 0.1, 20.0), (4, "F", 1, False, 0.5, -1.0, 0.1, 20.0)], "fund_id long, class string, risk_level int, screened boolean, alpha double, blended double, efficiency double, momentum double")
    out = scoring.ranked(scoring.scores(clients(spark, (1, "Moderate", 6.0, None), (2, "Conservative", 4.0, True)), funds))
    got = {(r["client_id"], r["fund_id"]): r for r in out.collect()}
    assert got[1, 1]["returnfit_n"] == 80.0 and got[1, 3]["returnfit_n"] == 0.0 and (1, 1) in got and (2, 3) not in got
    assert got[1, 1]["position"] == 1 and got[1, 2]["position"] == 2 and got[1, 1]["composite"] == pytest.approx(26 + 0.42 * 80 + 6, abs=0.01)
    near = spark.createDataFrame([(1, 1, 70.0, 10.0, 1.0), (1, 2, 69.0, 20.0, 1.0), (1, 3, 50.0, 99.0, 1.0)], "client_id long, fund_id long, composite double, alpha_n double, efficiency_n double")
    assert {r["fund_id"]: r["position"] for r in scoring.ranked_banded(near).collect()} == {2: 1, 1: 2, 3: 3}
    assert {r["fund_id"]: r["position"] for r in scoring.ranked(near).collect()} == {1: 1, 2: 2, 3: 3}


def test_compared_ranking_is_pythons_sort(spark):
    """Near composites whose order isn't transitive, in batches that end within a client, rows in any order; against sorted() of whole rows."""
    import functools

    rng = random.Random(3)
    funds = [(c, f, round(rng.uniform(40, 60), 2), rng.randrange(8) / 1.0, rng.randrange(3) / 1.0) for c in (1, 2, 3) for f in range(700 * c)]

    def compare(a, b):
        return b[2] - a[2] if abs(a[2] - b[2]) > 2 else b[3] - a[3] or b[4] - a[4]

    want = [(*r, i) for c in (1, 2, 3) for i, r in enumerate(sorted((r for r in funds if r[0] == c), key=functools.cmp_to_key(compare)), 1)]
    rng.shuffle(funds)
    df = spark.createDataFrame(funds, "client_id long, fund_id long, composite double, alpha_n double, efficiency_n double").repartition(3)
    assert rows(scoring.ranked_banded(df, batch=512)) == sorted(want, key=str)
    empty = scoring.ranked_banded(df.where("client_id = 2 AND fund_id < 1").unionByName(df.limit(0)))
    assert empty.select("fund_id", "position").collect() == [(0, 1)]


def test_compared_ranking_holds_one_client():
    """What a worker holds for a client's funds while it sorts them, and that nothing of them stays for the next client, even if the garbage collector doesn't come by."""
    import gc
    import tracemalloc

    import numpy as np
    import pandas as pd

    class Grouped:
        select = groupBy = lambda self, *columns: self
        applyInPandas = lambda self, function, schema: function

    n, step, rng = 60_000, 2_000, np.random.default_rng(4)
    order, funds = scoring.ranked_banded(Grouped(), batch=step), rng.permutation(n)

    def parts(client):
        for i in range(0, n, step):
            tenths = rng.integers(0, 1001, (2, step)) / 10
            yield pd.DataFrame({"client_id": client, "fund_id": funds[i : i + step], "composite": rng.integers(2000, 9000, step) / 100, "alpha_n": tenths[0], "efficiency_n": tenths[1]})

    assert sum(map(len, order(parts(0)))) == n  # imports are done
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for client in range(1, 5):
            assert sum(map(len, order(parts(client)))) == n
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert kept < 8 * n and most < 100 * n


def test_compared_ranking_without_numbers(spark):
    """Null and infinite numbers compare as they are; what comes out are the numbers that came in."""
    import functools

    inf, rng = float("inf"), random.Random(8)
    funds = [(1, f, rng.choice((50.0, 51.5, 53.0, None)), rng.choice((1.5, 2.5, inf, -inf)), rng.choice((0.1, 0.3, None))) for f in range(200)]
    number = lambda v: float("nan") if v is None else v

    def compare(a, b):
        gap = number(b[2]) - number(a[2])
        return gap if abs(gap) > 2 else number(b[3]) - number(a[3]) or number(b[4]) - number(a[4])

    class Row(tuple):
        def __lt__(self, other):
            return compare(self, other) < 0

    want = [(r[1], i) for i, r in enumerate(sorted(map(Row, funds)), 1)]
    df = spark.createDataFrame(rng.sample(funds, len(funds)), "client_id long, fund_id long, composite double, alpha_n double, efficiency_n double")
    out = scoring.ranked_banded(df, batch=64)
    assert rows(out, "fund_id", "position") == sorted(want, key=str)
    assert rows(out, "fund_id", "alpha_n") == sorted(((r[1], r[3]) for r in funds), key=str)


def test_overlaps(spark):
    baskets = spark.createDataFrame([("A", x) for x in "12345"] + [("B", x) for x in "34567"] + [("B", "3")] + [("C", x) for x in "89"], "fund_id string, item string")
    pairs = portfolio.overlaps(baskets)
    assert rows(pairs) == rows(portfolio.overlaps(baskets, largest=5)) == [("A", "B", 3)]
    with pytest.raises(Exception, match="over 4 items"):
        portfolio.overlaps(baskets, largest=4).collect()
    picks = spark.createDataFrame([("A", 5.0, 1), ("B", 5.0, 2), ("C", 1.0, 3)], "fund_id string, alpha_n double, pos int")
    assert rows(portfolio.without_overlaps(picks, pairs), "fund_id") == [("A",), ("C",)]


def test_overlaps_of_large_baskets(spark):
    """Baskets of up to 500 items, some items in nearly all of them, two groups; against all pairs."""
    rng = random.Random(5)
    held = {(g, k): {rng.choice((rng.randrange(6), rng.randrange(4000))) for _ in range(rng.choice((2, 5, 40, 500)))} for g in "xy" for k in range(60)}
    df = spark.createDataFrame([(g, k, i) for (g, k), items in held.items() for i in items] + [("x", 0, None)], "g string, fund_id int, item int").repartition(3)
    for least in (1, 3, 9):
        want = sorted(((g, a, b, len(held[g, a] & held[g, b])) for g in "xy" for a in range(60) for b in range(a + 1, 60) if len(held[g, a] & held[g, b]) >= least), key=str)
        assert rows(portfolio.overlaps(df, within=["g"], least=least)) == want


def test_overlaps_counted(spark):
    """Counting gives the pairs that comparing gives: groups, repeated and null items, null holders, texts as keys."""
    rng = random.Random(6)
    held = {(g, f"k{k}"): {rng.randrange(60) for _ in range(rng.choice((1, 3, 12, 30)))} for g in "xy" for k in range(40)}
    df = spark.createDataFrame([(g, k, i) for (g, k), items in held.items() for i in items for _ in range(1 + i % 2)] + [("x", "k0", None), ("x", None, 3)], "g string, fund_id string, item int").repartition(3)
    for least in (1, 2, 4):
        want = sorted(((g, a, b, len(held[g, a] & held[g, b])) for g in "xy" for a in (f"k{k}" for k in range(40)) for b in (f"k{k}" for k in range(40)) if a < b and len(held[g, a] & held[g, b]) >= least), key=str)
        assert rows(portfolio.overlaps(df, within=["g"], least=least, counted=True)) == rows(portfolio.overlaps(df, within=["g"], least=least)) == want
    assert rows(portfolio.overlaps(df.limit(0), within=["g"], counted=True)) == []


def plain_ranks(values):
    key = lambda v: (v is not None, v)
    return {v: (values.count(v), sum(key(x) < key(v) for x in values), len(values)) for v in set(values)}


def test_value_ranks_and_medians(spark):
    """Groups of all sizes, one of nine tenths of the rows, with ties, nulls and one value only; against sorting."""
    rng = random.Random(6)
    data = {("big", None): [rng.choice((None, round(rng.gauss(0, 1), rng.choice((0, 3))))) for _ in range(3000)], ("one", 1): [5.0], ("none", 2): [None, None], ("same", 3): [2.0] * 9, (None, 4): [1.0, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame([(a, b, v) for (a, b), values in data.items() for v in values], "a string, b int, v double").repartition(3)
    want = sorted(((a, b, v, *rank) for (a, b), values in data.items() for v, rank in plain_ranks(values).items()), key=str)
    for parts in (2, 64):
        assert sorted((tuple(r) for r in ranks.value_ranks(df, ["a", "b"], "v", parts=parts).collect()), key=str) == want
    for upper in (False, True):
        middle = {k: sorted(v for v in values if v is not None) for k, values in data.items()}
        exact = {k: v[len(v) // 2] if upper else statistics.median(v) for k, v in middle.items() if v}
        assert {(r["a"], r["b"]): r["median"] for r in ranks.medians(df, ["a", "b"], "v", upper=upper).collect()} == exact


def test_value_ranks_dont_depend_on_order(spark):
    """A plan reads the counts more than once, on a cluster in another order each time; here rows come in a new order whenever they are read."""

    def mixed(parts):
        for part in parts:
            yield part.sample(frac=1)

    rows = spark.range(160000).select(F.col("id").cast("double").alias("v"), F.lit("x").alias("g"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ranks.value_ranks(rows.mapInPandas(mixed, rows.schema), ["g"], "v").where("n = 1 AND total = 160000 AND below = v").count()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == 160000


def test_class_percentiles_spread_a_large_class(spark):
    """A class with nine tenths of all rows is dealt over tasks: no window is over a class, and its values are ranked in parts."""
    rng = random.Random(7)
    df = spark.createDataFrame([(i, "big" if i % 10 else "small", rng.choice((0.0, rng.random()))) for i in range(5000)], "fund_id int, class string, x double")
    out = scoring.class_percentiles(df, ["class"], {"p": "x"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line), plan
    for name, got in {n: {r["fund_id"]: r for r in out.where(F.col("class") == n).collect()} for n in ("big", "small")}.items():
        values = sorted(r["x"] for r in got.values())
        assert len(values) == (4500 if name == "big" else 500)
        for r in random.Random(8).sample(list(got.values()), 200):
            assert abs(r["p"] - 100 * bisect.bisect_left(values, r["x"]) / (len(values) - 1)) <= 0.0501


def test_bands(spark):
    """A band goes on while neighbours are within two points; within it alpha and efficiency decide, then the fund."""
    data = [(1, 1, 90.0, 1.0, 0.0), (1, 2, 88.5, 9.0, 0.0), (1, 3, 86.6, 9.0, 5.0), (1, 4, 84.5, 99.0, 0.0), (1, 5, 84.5, 99.0, 0.0), (2, 6, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "client_id int, fund_id int, composite double, alpha_n double, efficiency_n double")
    assert rows(scoring.ranked_bands(df), "client_id", "fund_id", "band", "position") == [(1, 1, 1, 3), (1, 2, 1, 2), (1, 3, 1, 1), (1, 4, 2, 4), (1, 5, 2, 5), (2, 6, 1, 1)]
    assert rows(scoring.ranked_bands(df, width=0.0), "fund_id", "position") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1)]


def test_shares(spark):
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 1.0), ("p", 3, 1.0), ("q", 1, 0.0), ("q", 2, 0.0)], "k string, pos int, amount double")
    out = portfolio.normalised(df, ["k"], "amount", "pos")
    assert rows(out, "k", "pos", "pct") == [("p", 1, 33.4), ("p", 2, 33.3), ("p", 3, 33.3), ("q", 1, 0.0), ("q", 2, 0.0)]
    assert rows(portfolio.slice_bounds(out, ["k"]), "pos", "start", "end") == [(1, 0.0, 33.4), (2, 33.4, 66.7), (3, 66.7, 100.0)]


def plain_spill(p, cap):
    p, spill = list(p), 0.0
    for i in range(len(p)):
        over = max(p[i] - cap, 0.0)
        p[i] -= over
        for j in range(len(p)):
            take = 0.0 if j == i else min(max(cap - p[j], 0.0), over)
            p[j] += take
            over -= take
        spill += over
    return [round(x, 6) for x in p], round(spill, 6)


def test_cap_and_spill(spark):
    rng = random.Random(2)
    cases = [[round(rng.uniform(0, 90), 1) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    df = spark.createDataFrame([(i, c, 50.0) for i, c in enumerate(cases)], "i int, shares array<double>, cap double")
    for r in portfolio.cap_and_spill(df).collect():
        p, spill = plain_spill(cases[r["i"]], 50.0)
        assert r["capped"] == pytest.approx(p, abs=0.051) and r["spill"] == pytest.approx(spill, abs=0.051)
        assert sum(r["capped"]) + r["spill"] == pytest.approx(sum(cases[r["i"]]), abs=0.21)


BOOK = "client_id long, profile string, pos int, fund string, role string, pct double, alpha_n double"


def test_substitutions(spark):
    book = spark.createDataFrame([(c, p, i, f, r, x, a) for c, p in ((1, "Moderate"), (2, "Aggressive")) for i, f, r, x, a in ((1, "A", "core", 45.0, 70.0), (2, "B", "core", 35.0, 30.0), (3, "GOLD", "sleeve", 10.0, None), (4, "CASH", "sleeve", 10.0, None))], BOOK)
    cand = "client_id long, fund string, position int, alpha_n double, alpha_3y double, alpha_5y double, matches boolean"
    pool = spark.createDataFrame([(c, "A", 1, 99.0, 9.0, 9.0, True) for c in (1, 2)] + [(c, f, n, a, x, y, m) for c in (1, 2) for f, n, a, x, y, m in (("N", 2, 60.0, 9.0, None, True), ("Z", 3, 95.0, 0.0, None, True), ("M", 4, 95.0, 9.0, None, False), ("Q", 5, 95.0, 9.0, None, True), ("R", 6, 99.0, 9.0, 1.0, True))], cand)
    out = portfolio.outlier_swap(book, pool)
    assert rows(out.where("role = 'outlier'"), "client_id", "fund", "pct") == [(1, "Q", 35.0)]
    assert portfolio.outlier_swap(book, pool, blocked=spark.createDataFrame([(1, "Q")], "client_id long, fund string")).where("fund = 'R'").count() == 1
    unqualified = pool.withColumn("qualified", F.col("fund") != "Q")
    assert rows(portfolio.outlier_swap(book, unqualified).where("role = 'outlier'"), "client_id", "fund") == [(1, "R")]
    pairs = spark.createDataFrame([("A", "Q", 3), ("R", "Z", 3)], "a string, b string, shared long")
    assert rows(portfolio.outlier_swap(book, pool, portfolio.blocked_by(book, pairs)).where("role = 'outlier'"), "client_id", "fund") == [(1, "R")]
    gaps = spark.createDataFrame([(1,), (2,)], "client_id long")
    one_pick = spark.createDataFrame([(c, f, 1, 50.0, a, None, True) for c in (1, 2) for f, a in (("G", 1.5), ("H", None), ("A", 9.0))], cand)
    swapped = portfolio.gap_swap(out, portfolio.gap_pick(one_pick, out), gaps)  # client 1 holds an outlier
    assert swapped.columns == out.columns and rows(swapped.where("role = 'gap'"), "client_id", "fund", "pct") == [(2, "G", 15.0)]
    # 45 and the 20 that are freed are over the cap of 50: 15 go on to the first sleeve
    assert rows(swapped.where("client_id = 2 AND role <> 'gap'"), "fund", "pct") == [("A", 50.0), ("CASH", 10.0), ("GOLD", 25.0)]
    assert rows(portfolio.gap_swap(book.withColumn("cap", F.lit(70.0)), portfolio.gap_pick(one_pick, book), gaps).where("client_id = 2"), "fund", "pct") == [("A", 65.0), ("CASH", 10.0), ("G", 15.0), ("GOLD", 10.0)]
    assert rows(swapped.groupBy("client_id").agg(F.round(F.sum("pct"), 1))) == [(1, 100.0), (2, 100.0)]
    alone = book.where("fund <> 'A' AND client_id = 1").withColumn("pct", F.when(F.col("fund") == "B", 80.0).otherwise(F.col("pct")))
    assert rows(portfolio.gap_swap(alone, portfolio.gap_pick(one_pick, alone), gaps), "fund", "pct") == [("A", 50.0), ("CASH", 10.0), ("GOLD", 40.0)]
    assert rows(portfolio.gap_swap(book, portfolio.gap_pick(one_pick.withColumn("alpha_3y", F.lit(-0.5)), book), gaps)) == rows(book)
    assert portfolio.gap_swap(book, portfolio.gap_pick(one_pick, book), gaps.limit(0)).where("role = 'gap'").count() == 0
    edits = spark.createDataFrame([(1, 1, "Q", 50.0), (1, 2, "X", 50.0), (2, 1, None, 5.0)], "client_id long, pos int, fund string, pct double")
    new, bad = portfolio.edited(out, edits)
    assert rows(new.where("client_id = 1"), "fund", "role") == [("Q", "outlier"), ("X", "core")] and bad.count() == 1 and new.where("client_id = 2").count() == 4


SLEEVES = {"gold": "GOLD", "money_market": "CASH", "money_market_screened": "PURE"}


def test_base_portfolio(spark):
    """Against a plain version: budgets of the profile, the sleeve of the wish, structural funds are never cores, 100 in all."""
    rng = random.Random(9)
    clients = [(c, profile, wish, cap) for c, (profile, wish, cap) in enumerate((p, w, k) for p in config.TEMPLATES for w in (True, False, None) for k in (30.0, 50.0, 70.0))]
    scored = [(c, f, rng.choice((0.0, float(rng.randrange(100)))), rng.random(), rng.random(), rng.random() < 0.3) for c, *_ in clients for f in range(rng.choice((1, 2, 7)))]
    scored += [(99, 1, 5.0, 1.0, 1.0, True)]  # nothing but a structural fund: no portfolio
    out = portfolio.base_portfolio(
        spark.createDataFrame(scored, "client_id long, fund_id long, composite double, alpha_n double, efficiency_n double, structural boolean"),
        spark.createDataFrame([*clients, (99, "Moderate", None, 50.0)], "client_id long, profile string, preference boolean, cap double"), SLEEVES,
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["client_id"], {})[r["pos"]] = (r["fund"], r["role"], r["pct"])
    for c, profile, wish, cap in clients:
        best = sorted((-s, -a, -e, f) for k, f, s, a, e, structural in scored if k == c and not structural)[:2]
        if not best:
            assert c not in got
            continue
        budget, gold, money = config.TEMPLATES[profile]
        total = -sum(b[0] for b in best)
        raw = [budget * -b[0] / total if total else budget / 2 for b in best] + [gold, money]
        pct = [float(Decimal(x / sum(raw) * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in raw]
        pct[pct.index(max(pct))] += 100 - sum(pct)
        capped, spill = plain_spill(pct[: len(best)], cap)
        want = [round(x, 1) for x in (*capped, pct[-2] + spill, pct[-1])]
        mine = [got[c][p] for p in sorted(got[c])]
        assert [m[2] for m in mine] == pytest.approx(want, abs=0.051) and sum(m[2] for m in mine) == pytest.approx(100.0)
        assert [m[0] for m in mine] == [*(str(b[3]) for b in best), "GOLD", "PURE" if wish else "CASH"]
        assert [m[1] for m in mine] == ["core"] * len(best) + list(config.STRUCTURAL_ROLES)


def test_portfolio_violations(spark):
    def codes(*held, ceiling=3):
        df = spark.createDataFrame([(1, f, r, p, 50.0, ceiling) for f, r, p in held], "portfolio_id long, fund string, role string, pct double, cap double, ceiling int")
        facts = spark.createDataFrame([("A", 3), ("B", 4), ("C", None), ("G", 5), ("M", 1)], "fund string, risk_level int")
        return {r["code"] for r in checks.portfolio_violations(df, facts).collect()}

    gold, money = config.STRUCTURAL_ROLES
    good = (("A", "core", 40.0), ("C", "core", 40.0), ("G", gold, 10.0), ("M", money, 10.0))
    assert codes(("A", "core", 50.04), *good[1:2], ("G", gold, 9.96), ("M", money, 0.0)) == {"concentration_cap"} and codes(("A", "core", 50.0), *good[1:2], ("G", gold, 5.0), ("M", money, 5.0)) == set()
    assert codes(*good[:3], ("N", money, 10.0)) == {"universe"} and codes(*good[:3], ("M", "core", 10.0)) == {"structural"}
    assert codes(*good) == set()
    assert codes(("A", "core", 60.0), *good[1:]) == {"sum", "concentration_cap"}
    assert codes(*good[:3]) == {"sum", "count", "structural"}
    assert codes(("A", "core", 40.0), ("A", "core", 40.0), *good[2:]) == {"duplicate_holding"}
    assert codes(("B", "core", 40.0), *good[1:]) == {"rl_ceiling"} and codes(("B", "outlier", 40.0), *good[1:]) == set()
    assert codes(("X", "core", 40.0), *good[1:]) == {"universe"}


def test_document_checks(spark):
    page = "<h2>One</h2>x<h2>Two</h2> version=3 risk: a; terms: b"
    docs = spark.createDataFrame([(1, page, None), (2, "<h2>Two</h2><h2>One</h2> {{slot}} terms: risk: version=4", "Ann"), (3, "<h2>One</h2> For: Ann &amp; Bo", "Ann & Bo"), (4, "For: Eve", "Ann")], "doc_id long, html string, client_name string")
    names = lambda df: rows(df, "subject", "code")
    assert names(checks.section_violations(docs, "<h2>(.*?)</h2>", ["One", "Two"])) == [("2", "section_order"), ("3", "section_count"), ("4", "section_count")]
    assert ("2", "placeholder") in names(found := checks.required_text(docs, ["risk:", "terms:"], "{{", "3", "version=([0-9]+)")) and ("2", "disclosure_order") in names(found) and ("2", "version") in names(found) and ("1", "version") not in names(found) and ("3", "disclosure_missing") in names(found)
    assert names(checks.prepared_for(docs, "For: ")) == [("2", "recipient_line"), ("4", "recipient_name")]
    assert names(checks.unfilled(docs, [r"\{\{\w+\}\}", "TODO"])) == [("2", "unfilled_slot")]
    cards = checks.cards(spark.createDataFrame([(1, "top<card>Fund · ABC — core\nbody<card>Other · XY\n")], "doc_id long, html string"), "<card>")
    assert rows(cards, "pos", "code") == [(0, "ABC"), (1, "XY")]
    assert names(checks.unknown_keys(cards, spark.createDataFrame([("ABC",)], "code string"), "doc_id", "code")) == [("1", "unknown_fund")]
    bars = spark.createDataFrame([(1, 60.0, 100.0, 20.0), (2, 62.0, 100.0, 20.0), (3, None, 1.0, 1.0)], "doc_id long, shown double, a double, b double")
    assert names(checks.recomputed(bars, "doc_id", "cfs", "shown", [("a", 0.5), ("b", 0.5)], 1.0)) == [("2", "cfs")]
    legend = spark.createDataFrame([(1, "x", 60.0), (1, "x", 41.0), (2, "x", 90.0), (3, "x", None)], "doc_id long, block string, pct double")
    assert names(checks.sums_off(legend, "doc_id", "block", "pct")) == [("2", "exposure_sum")]
    state = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "key string, v double")
    shown = spark.createDataFrame([("a", 1.04), ("b", 2.1), ("d", 1.0)], "key string, v double")
    assert names(checks.reconciled(state, shown, "key", {"v": 0.05})) == [("b", "render_v"), ("c", "render_missing"), ("d", "render_extra")]
    warn = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "doc_id long, warned boolean, out boolean")
    assert names(checks.both_or_neither(warn, "doc_id", F.col("warned"), F.col("out"), "warning")) == [("1", "warning"), ("3", "warning")]
    assert names(checks.labels_outside(warn.withColumn("kind", F.lit("x")), "doc_id", {"kind": ["x", "y"]})) == []


POINTS = [(1, "2024-01-01", 5.0), (1, "2024-01-02", 9.0), (1, "2024-01-03", 9.0), (1, "2024-01-04", None), (2, "2024-01-01", None), (3, "2024-02-01", -1.0)]


def points(spark, data=POINTS):
    return spark.createDataFrame([(f, dt.date.fromisoformat(d), v) for f, d, v in data], "fund_id long, nav_date date, nav double")


def test_all_time_high(spark):
    got = {r["fund_id"]: r for r in nav.drawdown(nav.all_time_high(points(spark)), F.lit("2024-01-12").cast("date")).collect()}
    assert (got[1]["ath_nav"], str(got[1]["ath_date"]), got[1]["points"], got[1]["drawdown_pct"], got[1]["days_from_ath"]) == (9.0, "2024-01-02", 4, 0.0, 10)
    assert got[2]["ath_nav"] is None and got[2]["points"] == 1 and got[3]["drawdown_pct"] is None
    assert rows(nav.upper_median(spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "v double").withColumn("k", F.lit(1)), "v", ["k"])) == [(1, 3.0)]
    assert rows(nav.drawdown_summary(nav.drawdown(nav.all_time_high(points(spark)).limit(0), F.lit("2024-01-12").cast("date")))) == [(0, 0, 0, 0, 0, 0, None)]


def test_incremental_is_full(spark):
    rng = random.Random(1)
    data = [(f, str(dt.date(2024, 1, 1) + dt.timedelta(d)), rng.choice([None, round(rng.uniform(1, 5), 1)])) for f in range(4) for d in range(30)]
    full = rows(nav.all_time_high(points(spark, data)))
    for day in ("2024-01-05", "2024-01-20", "2024-02-20"):
        before = points(spark, [x for x in data if x[1] <= day])
        old = nav.all_time_high(before)
        rest = nav.new_points(points(spark, data), old.withColumn("current_date", F.lit(day).cast("date")))
        assert rows(nav.merged(old, nav.all_time_high(rest))) == full


def test_halves_are_the_whole_history(spark):
    """A history of a month within the first 90 days of a year, and one of over a year; both halves hold points."""
    rng = random.Random(2)
    for days, every in ((30, 1), (500, 9)):
        data = [(f, str(dt.date(2023, 1, 1) + dt.timedelta(d)), rng.choice([None, round(rng.uniform(1, 5), 1)])) for f in range(4) for d in range(f, days, every)]
        data += [(9, "2023-01-02", None), (9, data[-1][1], 3.0)]
        old, rest = nav.halves(points(spark, data))
        n_old, n_new = old.agg(F.sum("points")).first()[0], rest.count()
        assert min(n_old, n_new) > len(data) / 3 and n_old + n_new == len(data)
        assert rows(nav.merged(old, nav.all_time_high(rest))) == rows(nav.all_time_high(points(spark, data)))


def test_incremental_query_merges_new_points(spark):
    from quayside.plans import catalog

    seen = []
    kept = nav.new_points
    try:
        nav.new_points = lambda *a, **b: seen.append(kept(*a, **b)) or seen[-1]
        catalog.ath_incremental(spark, "/root/testdata/sf0.001")
    finally:
        nav.new_points = kept
    assert seen and seen[0].count() > 0


def test_day_sets_count_each_day_once(spark):
    """Histories cut anyhow, with deliveries that come again and in any order: the merge is that of the whole."""
    rng = random.Random(3)
    data = [(f, str(dt.date(1965, 1, 1) + dt.timedelta(rng.randrange(4000))), float(f)) for f in (1, 2) for _ in range(300)]
    data = sorted(set(data))
    deliveries = [rng.sample(data, 200) for _ in range(4)] + [data[:250], data[250:]]
    days = nav.day_sets(points(spark, deliveries[0]))
    state = nav.all_time_high(points(spark, deliveries[0]))
    for d in deliveries[1:] + deliveries[:1]:
        days, state = nav.merged_days(days, nav.day_sets(points(spark, d))), nav.merged(state, nav.all_time_high(points(spark, d)))
    assert rows(nav.counted(state, days)) == rows(nav.all_time_high(points(spark, data)))


def test_merge_takes_late_corrections(spark):
    """An equal high on an earlier day, and a higher price of the last day, count whichever side they come from."""
    a, b = [(1, "2024-01-05", 9.0), (1, "2024-01-09", 2.0)], [(1, "2024-01-03", 9.0), (1, "2024-01-09", 3.0)]
    whole = nav.all_time_high(points(spark, a + b))
    for x, y in ((a, b), (b, a)):
        assert rows(nav.merged(nav.all_time_high(points(spark, x)), nav.all_time_high(points(spark, y)))) == rows(whole)


def test_stream_keeps_the_same_state(spark, tmp_path):
    """Batches of which one repeats points of another, one comes long after, and one is merged twice; old versions go."""
    late = POINTS[:3]
    for k, part in enumerate((POINTS[:2], POINTS[2:4] + POINTS[1:2], POINTS[4:], late)):
        points(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
        for f in (tmp_path / "in" / f"p{k}").glob("part-*"):
            f.rename(tmp_path / f"in{k}.parquet")
    folder, state = tmp_path / "landed", tmp_path / "state"
    folder.mkdir()
    for k in range(4):
        (tmp_path / f"in{k}.parquet").rename(folder / f"in{k}.parquet")
        query = stream.keep_state(stream.points_stream(spark, str(folder)), str(state), str(tmp_path / "checkpoint"), buckets=4)
        query.awaitTermination(120)
    highs = Versions(spark, f"{state}/highs")
    assert highs.committed() == [2, 3] and rows(highs.read(nav.STATE)) == rows(nav.all_time_high(points(spark)))
    # the checkpoint is lost and all comes again as one batch of a number that isn't known
    again = stream.keep_state(stream.points_stream(spark, str(folder)), str(state), str(tmp_path / "other"), buckets=4)
    again.awaitTermination(120)
    assert rows(highs.read(nav.STATE)) == rows(nav.all_time_high(points(spark)))


def test_versions_survive_a_crash(spark, tmp_path, monkeypatch):
    """What dies between its files and its manifest leaves the last version; parts that aren't written are shared; vacuum removes what no version names."""
    table = Versions(spark, str(tmp_path / "t"))
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert table.committed() == [] and table.read("v int").count() == 0
    assert table.write(1, {"a": frame(1), "b": frame(2)}) and table.write(2, {"b": frame(3)}) and not table.write(2, {"b": frame(9)})
    assert rows(table.read("v int")) == [(1,), (3,)] and rows(table.read("v int", ["b"], before=2)) == [(2,)]
    with monkeypatch.context() as m:
        m.setattr(Versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.write(3, {"a": frame(7)})
    assert table.committed() == [1, 2] and rows(table.read("v int")) == [(1,), (3,)]
    table.write_buckets(4, spark.createDataFrame([(5, 0), (6, 1)], "v int, bucket int"), "bucket", [0, 1])
    table.write_buckets(5, spark.createDataFrame([(8, 1)], "v int, bucket int"), "bucket", [1, 0])  # bucket 0 is empty now
    assert rows(table.read("v int")) == [(1,), (3,), (8,)]
    gone = table.vacuum(1)
    assert table.committed() == [5] and rows(table.read("v int")) == [(1,), (3,), (8,)] and len(gone) == 3
    with pytest.raises(Exception, match="exist"):
        table._commit(5, {})  # another writer's version isn't replaced
    old, new = spark.createDataFrame([(1, "x"), (2, "x")], "k int, s string"), spark.createDataFrame([(2, "y"), (3, "y")], "k int, s string")
    assert rows(kept_on_failure(old, new, "k")) == [(1, "x"), (2, "y"), (3, "y")]


def test_master_keeps_other_months(spark, tmp_path):
    path = str(tmp_path / "m")
    frame = lambda *x: spark.createDataFrame(x, "abbr string, x double, report_month string")
    tables.write_master(frame(("a", 1.0, "2024-01"), ("b", 1.0, "2024-01")), path)
    tables.write_master(frame(("a", 2.0, "2024-02")), path)
    tables.write_master(frame(("a", 3.0, "2024-02")), path)
    assert rows(spark.read.parquet(path), "abbr", "x", "report_month") == [("a", 1.0, "2024-01"), ("a", 3.0, "2024-02"), ("b", 1.0, "2024-01")]


def test_variants(spark, tmp_path):
    """Files that are broken or of another form, values of another type and unknown keys."""
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "a.json").write_text('{"base_dir": "b", "all_funds": [{"name": "F", "abbr": "A", "total_periods": 2, "odd": {"x": [1]}, "period_detail": {"1y": {"fund": 1.5}}}, {"abbr": "B", "total_periods": "many"}, null, 7, {"name": null}]}')
    for name, text in (("b", '{"all_funds": ['), ("c", '{"all_funds": "none"}'), ("d", " "), ("e", "[]")):
        (folder / f"{name}.json").write_text(text)
    good, bad = variants.snapshot(spark, str(folder))
    assert rows(good, "row_seq", "base_dir", "name", "abbr", "total_periods") == [(0, "b", "F", "A", 2), (4, "b", None, None, None)]
    assert rows(good.where("row_seq = 0").select(F.map_keys("unknown"), F.variant_get(F.col("period_detail")["1y"], "$.fund", "double"))) == [(["odd"], 1.5)]
    assert sorted((r["path"][-6:], r["row_seq"], r["reason"]) for r in bad.collect()) == [("a.json", 1, "total_periods isn't int"), ("a.json", 3, "no object"), ("b.json", None, "no JSON"), ("c.json", None, "no list at $.all_funds"), ("d.json", None, "no JSON"), ("e.json", None, "no list at $.all_funds")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('{"client_name": "n", "shariah": "perhaps"}')
    (tmp_path / "p" / "y.json").write_text('{"client_name": "n", "shoe_size": 1}')
    good, bad = variants.profiles(spark, str(tmp_path / "p"))
    assert rows(good, "client_name", "shariah") == [("n", None)] and rows(bad, "reason") == [("shariah isn't boolean",)]
    (tmp_path / "e.json").write_text('{"events": [{"date": "2024-01-01", "theme": "t", "claim": "c", "extra": 1}, {"date": "2024"}]}')
    good, bad = variants.events(spark, str(tmp_path / "e.json"))
    assert rows(good, "row_seq", "theme") == [(0, "t")] and rows(bad, "row_seq", "reason") == [(1, "theme is missing")]


def test_profiles_of_a_list(spark, tmp_path):
    """A file may hold many clients, good and bad ones; what is neither a profile nor a list of them is a reject."""
    for name, text in (("x", '[{"client_name": "a"}, null, {"client_name": "b", "shariah": "perhaps"}, {"client_name": "c", "shariah": true}, 7]'), ("y", '{"client_name": "d"}'), ("z", "[]"), ("n", "null")):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = variants.profiles(spark, str(tmp_path))
    assert rows(good, "client_name", "shariah") == [("a", None), ("c", True), ("d", None)]
    assert sorted((r["path"][-6:], r["reason"]) for r in bad.collect()) == [("n.json", "no object"), ("x.json", "no object"), ("x.json", "shariah isn't boolean"), ("z.json", "no object")]


def test_a_month_of_the_master_is_one_file(spark, tmp_path):
    """Not one of every task that has rows of it."""
    months = spark.range(0, 400, 1, 8).select("id", F.format_string("2024-%02d", F.col("id") % 12 + 1).alias("report_month"))
    tables.write_master(months, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").rglob("*.parquet"))) == 12 and spark.read.parquet(str(tmp_path / "m")).count() == 400


def test_render_fidelity(spark):
    """Each kind of fact with a wrong value, values that can't be read, facts that state lacks, labels with entities that have changed places."""
    page = (
        '<b data-slot="cfs">70.20</b><b data-slot="cfs">70.9</b><b data-slot="other">1</b><div>Exposure</div><i>Cash &amp; Gold</i><u>40.0%</u><i>Rest</i><u>60.0%</u><i>New</i><u>5%</u><hr><i>Rest</i><u>9%</u>'
        '<div class="card">Core · A — x\n<s>80.05</s><a>20.0%</a><em>Plain</em><q>—</q><div class="card">Core · B — x\n<s>80.06</s><a>+1,020.0%</a><em>Screened</em><q>3.5</q>'
    )
    docs = spark.createDataFrame([(1, page), (2, "nothing"), (3, None)], "doc_id int, html string")
    cards = checks.cards(docs, '<div class="card">')
    facts = checks.card_facts(cards, {"score": "<s>([^<]*)<", "share": "<a>([^<]*)<", "label": "<em>(\\w+)", "vol": "<q>([^<]*)<"})
    facts = facts.unionByName(checks.labelled_facts(docs, "exposure", "<i>([^<]*)</i><u>([^<]*)<", "(?s)Exposure(.*?)<hr>")).unionByName(checks.labelled_facts(docs, "slot", 'data-slot="([^"]*)">([^<]*)<'))
    state = [("score", "A", "80.0"), ("score", "B", "80.0"), ("share", "A", "20"), ("share", "B", "1020"), ("label", "A", "Plain"), ("label", "B", "Plain"), ("vol", "A", "2.0"), ("vol", "B", "3.4"), ("exposure", "Cash & Gold", "60"), ("exposure", "Rest", "40"), ("slot", "cfs", "70.2")]
    state = spark.createDataFrame([(1, *x) for x in state], "doc_id int, kind string, name string, value string")
    assert rows(checks.fidelity_violations(facts, state, labels=("label",)), "subject", "code") == [("1/B", "label"), ("1/B", "score"), ("1/B", "vol"), ("1/Cash & Gold", "exposure"), ("1/Rest", "exposure"), ("1/cfs", "slot")]
    assert rows(checks.fidelity_violations(facts, state, labels=("label",), tolerances={"exposure": 30.0, "vol": 0.2}), "subject", "code") == [("1/B", "label"), ("1/B", "score"), ("1/cfs", "slot")]
    held = spark.createDataFrame([(1, "A"), (1, "C"), (2, "A")], "doc_id int, name string")
    assert rows(checks.uncovered(held, cards), "subject", "code") == [("1/C", "coverage"), ("2/A", "coverage")]


def test_fidelity_beside_its_document(spark):
    """Facts against the state in their document's row give what facts and state as tables give: wrong values, a card twice, unreadable values, cards that state lacks, holdings without a card, a null document."""
    card = lambda name, score, label: f'<div class="card">Core · {name} — x\n<s>{score}</s><em>{label}</em>'
    docs = [(1, "<i>Cash &amp; Gold</i><u>40.0%</u><i>Rest</i><u>60.0%</u><i>New</i><u>5%</u>" + card("A", "80.05", "Plain") + card("B", "80.06", "Screened") + card("B", "80.06", "Plain") + card("Z", "1", "Plain")), (2, card("A", "—", "") + card("C", "+1,020%", "Plain")), (3, None)]
    held = {1: [("A", "80.0", "Plain"), ("B", "80.0", "Plain"), ("D", "1", "Plain")], 2: [("A", "3", "Plain"), ("C", "1020", None), ("D", "1", "Plain"), ("D", "2", "Plain")], 3: [("A", "1", "Plain")]}
    mix = {1: [("Cash & Gold", "60"), ("Rest", "60.04")], 2: [("Rest", "1")], 3: []}
    df = spark.createDataFrame([(i, html, held[i], mix[i]) for i, html in docs], "doc_id int, html string, held array<struct<name: string, score: string, label: string>>, mix array<struct<name: string, value: string>>")
    patterns, pair = {"score": "<s>([^<]*)<", "label": "<em>(\\w+)"}, "<i>([^<]*)</i><u>([^<]*)<"
    cards = checks.cards(df, '<div class="card">')
    state = [(i, kind, h[0], h[at]) for i, hs in held.items() for h in hs for at, kind in ((1, "score"), (2, "label"))] + [(i, "mix", *m) for i, ms in mix.items() for m in ms]
    state = spark.createDataFrame(state, "doc_id int, kind string, name string, value string")
    facts = checks.card_facts(cards, patterns).unionByName(checks.labelled_facts(df, "mix", pair))
    names = spark.createDataFrame([(i, h[0]) for i, hs in held.items() for h in hs], "doc_id int, name string")
    want = rows(checks.all_of(checks.fidelity_violations(facts, state, labels=("label",)), checks.uncovered(names, cards)))
    got = checks.all_of(checks.card_fidelity(df, '<div class="card">', patterns, "held", labels=("label",)), checks.labelled_fidelity(df, "mix", pair, "mix"))
    assert rows(got) == want and {r[0] for r in want} == {"1/B", "1/Cash & Gold", "1/D", "2/D", "3/A"} and len(want) == 7


def test_exposures(spark):
    held = spark.createDataFrame([(1, "A", "core", 60.0), (1, "B", "core", 40.0), (2, "A", "core", 90.0), (2, "B", "gold", 10.0), (3, "C", "core", 100.0)], "portfolio_id long, fund_id string, role string, weight double")
    funds = spark.createDataFrame([("A", 80.0, 10.0, 10.0), ("B", 50.0, 20.0, 30.0)], "fund_id string, dom double, fgn double, mm double")
    out = exposure.asset_exposure(held, funds, {"dom": ["dom"], "fgn": ["fgn"], "gold": ["mm"], "rest": ["mm"]}, {"gold": "gold"})
    got = {(r["portfolio_id"], r["slice"]): r["pct"] for r in out.collect()}
    assert got[3, "rest"] == 100.0 and got[2, "gold"] > 10.0 and sum(v for (p, _), v in got.items() if p == 1) == pytest.approx(100.0)
    places = spark.createDataFrame([("A", "Home", 1.0), ("A", "X", 97.5), ("A", "Y", 1.5), ("B", "X", 100.0)], "fund_id string, place string, share double")
    spread = exposure.place_exposure(held.where("portfolio_id < 3"), places, home="Home")
    assert rows(spread.where("portfolio_id = 1"), "pos", "place", "pct") == [(1, "Home", 0.6), (2, "X", 98.5), (3, "Other", 0.9)]
    facts = spark.createDataFrame([("A", 80.0, None, 2)], "fund_id string, composite double, alpha_3y double, risk_level int")
    assert rows(exposure.portfolio_averages(held.where("portfolio_id = 1"), facts)) == [(1, 48.0, 0.0, 2.4, 2)]
    labels = spark.createDataFrame([(1, "Equity"), (1, "Equity"), (1, "Gold")], "portfolio_id long, label string")
    assert rows(exposure.composition(labels, ["Gold", "Cash", "Equity"])) == [(1, "1 Gold, 2 Equity")]
    assert (1, None, 1000.0) in rows(exposure.contributions(held.where("portfolio_id = 1")))


def test_extraction(spark):
    boxes = spark.createDataFrame([("d", 1, 400.0, 10.1, "b"), ("d", 1, 350.0, 9.0, "a"), ("d", 1, 10.0, 9.0, "left"), ("d", 1, 350.0, 14.0, "c")], "doc string, page int, x0 double, top double, text string")
    assert rows(extraction.boxes_to_lines(boxes, 595.2), "y", "text") == [(12.0, "b"), (16.0, "c"), (8.0, "a")]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x", "Top 5", "Tech 10.5%", "12.5", "Japan 3.0%", "Japan 4.0%", "END", "no"])] + [("e", 0, "Top 5"), ("e", 1, "tail line")], "doc string, pos int, line string")
    part = extraction.section(lines, "doc", "^Top 5", ["^END", "^STOP"])
    assert rows(part, "doc", "line") == [("d", "12.5"), ("d", "Japan 3.0%"), ("d", "Japan 4.0%"), ("d", "Tech 10.5%"), ("e", "tail line")]
    assert rows(extraction.named_percents(part, "doc"), "name", "pct") == [("Japan", 4.0), ("Tech", 10.5)]
    assert rows(extraction.named_percents(part, "doc", allowed=spark.createDataFrame([("Tech",)], "name string")), "name") == [("Tech",)]
    assert [r["line"] for r in extraction.first_lines(part.where("doc = 'd'"), "doc", 2).orderBy("rank").collect()] == ["Tech 10.5%", "Japan 3.0%"]
    pages = spark.createDataFrame([(1, "YTD 1.0 2.0 1-year 9.0 8.0 3.5 2.5")], "doc long, text string")
    found = extraction.period_returns(pages, "doc", "text", {"ytd": "YTD", "1y": "1-year", "3y": "3-year"})
    assert rows(found, "period", "fund_ret", "bench_ret", "total") == [("1y", 3.5, 2.5, False), ("ytd", 1.0, 2.0, True)] and rows(extraction.year_to_date(found, "doc")) == [(1, 1.0)]
    lists = spark.createDataFrame([(1, ["2020", "2021", "x"], ["1.0", "-"], ["2.0", "3.0", "4.0"])], "k long, y array<string>, f array<string>, b array<string>")
    assert rows(extraction.calendar_returns(lists, "k", "y", "f", "b")) == [(1, 2020, 1.0, 2.0)]
    got = extraction.fields(spark.createDataFrame([(1, "Size: 1,200 mil. Objective: grow and grow")], "k long, t string"), "k", "t", {"size": [r"Size: ([\d,]+)"], "aim": ["Aim: (.*)", "Objective: (.*)"], "none": ["zzz(.)"]}, {"aim": 8})
    assert rows(got) == [(1, "1,200", "grow and", None)]
    assert one(spark, extraction.without_noise(F.lit("Annual. Note: x"), ["Note:"]), extraction.without_noise(F.lit("Note: x"), ["Note:"])) == ("Annual.", "Note: x")
    table = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Equity", "and related 60.0%", "securities", "Cash 40.0%", "Total"])], "doc string, pos int, line string")
    assert rows(extraction.allocation(table, "doc"), "label", "pct") == [("Cash", 40.0), ("Equity and related securities", 60.0)]
    blocks = extraction.blocks(spark.createDataFrame([("d", i, t) for i, t in enumerate("xHaaHb")], "doc string, page int, t string"), "doc", "page", F.col("t") == "H")
    assert rows(blocks, "page", "block") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"base_dir": "b", "all_funds": [{"name": "F", "abbr": "A", "source_file": "[MFR JAN24] x.pdf", "unknown": 1, "period_detail": {"1y": {"fund": 1.0, "bench": 2.0, "alpha": -1.0}}}, {"abbr": "B"}]}')
    funds = tables.nested_snapshot(spark, str(tmp_path / "s.json"))
    assert rows(funds, "row_seq", "abbr", "name") == [(0, "A", "F"), (1, "B", None)] and rows(tables.vintage(funds)) == [("JAN2024",)]
    (tmp_path / "c.json").write_text('{"fetched": "2024", "count": 2, "codes": {"A": "1", "B": "2"}}')
    assert rows(tables.code_map(spark, str(tmp_path / "c.json")), "abbr", "code") == [("A", "1"), ("B", "2")]
    (tmp_path / "p.json").write_text('{"client_name": "x", "risk_level": "Moderate", "shariah": null}')
    assert rows(tables.profiles(spark, str(tmp_path / "p.json")), "client_name", "shariah", "target_annual_return_pct") == [("x", None, None)]
    (tmp_path / "e.json").write_text('{"events": [{"date": "2024-01-01", "theme": "t", "claim": "c", "extra": 1}, {"date": "2024"}], "exposure_gaps": ["g"]}')
    good, bad = tables.events(spark, str(tmp_path / "e.json"))
    assert (good.count(), bad.count()) == (1, 1)
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    good, bad = tables.delimited(spark.createDataFrame([("x | 1.5",), ("y|z",), ("1|2|3",), ("q|",)], "value string"), schema)
    assert rows(good) == [("q", None), ("x", 1.5)] and rows(bad) == [("1|2|3", "fields: 3"), ("y|z", "b")]
    paths = spark.createDataFrame([("/d/[MFR JAN24] s.pdf",), ("/d/[MFR DEC23] s.pdf",), ("/d/[MFR FEB24] PRS.pdf",), ("/d/other.pdf",)], "path string")
    assert rows(tables.latest_per_series(paths, without="PRS"), "series", "path") == [("s", "/d/[MFR JAN24] s.pdf")]
    versions = spark.createDataFrame([(1, "m_JAN2024_v1.9"), (0, "m_JAN2024_v1.10"), (0, "m_JAN2024_v1.9"), (0, "x")], "dir_prio int, path string")
    assert rows(tables.newest_version(versions)) == [("m_JAN2024_v1.10",)]
    dim = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 2), ("b", None, 3)], "k string, v int, seq int")
    assert rows(tables.dimension(dim, "k", "v", "seq")) == [("a", 2)]
    looked = tables.with_fallback(spark.createDataFrame([("AB",), ("a b",), ("zz",)], "k string"), spark.createDataFrame([("AB", 1), ("A b", 2)], "k string, v int"), "k", "v", S.key_form)
    assert rows(looked) == [("AB", 1), ("a b", 2), ("zz", None)]
    master = spark.createDataFrame([("a", 1.0, "2024-01")], "abbr string, x double, report_month string")
    tables.write_master(master, str(tmp_path / "m"))
    tables.write_master(master, str(tmp_path / "mc"), csv=True)
    assert rows(spark.read.parquet(str(tmp_path / "m")), "abbr", "report_month") == [("a", "2024-01")] and spark.read.csv(str(tmp_path / "mc"), header=True).count() == 1
    assert tables.write_state(master, master.limit(0), str(tmp_path / "st"), 1, "abbr") and Versions(spark, str(tmp_path / "st")).read("abbr string", ["errors"]).count() == 0
    assert tables.state_or_empty(spark, str(tmp_path / "none"), nav.STATE).count() == 0
