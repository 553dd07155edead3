"""Model portfolios for all clients at once: overlaps, shares, caps, substitutions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.config import STRUCTURAL_ROLES, TEMPLATES
from quayside.functions.rows import computed
from quayside.functions.scalars import half_up
from quayside.operators.scoring import best_of


def subsets(items: Column, k: int) -> Column:
    """All subsets of k items of an array, as arrays in its order."""
    at = F.when(F.size(items) >= k, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    chosen = F.transform(at, lambda i: F.array(i))
    for _ in range(k - 1):
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter(at, lambda j: j > F.element_at(c, -1)), lambda j: F.concat(c, F.array(j)))))
    return F.transform(chosen, lambda c: F.transform(c, lambda i: F.get(items, i)))


def overlaps(baskets: DataFrame, key: str = "fund_id", item: str = "item", within: list[str] | None = None, least: int = 3, largest: int | None = None, counted: bool = False) -> DataFrame:
    """Pairs (a < b) of one group that share least distinct items or more, and how many; never all pairs. Null items are no items.

    Where baskets are known to be small (largest: a fund's top holdings), they meet on subsets of least items: a joined row is a result but for pairs that meet in several subsets,
    which are kept in the first only, and an item that very many hold costs nothing by itself. A basket of n items has n over least subsets, and one with over largest is an error.

    Baskets of any size (largest is None) meet on single items of a prefix. Items of a group are numbered from the rarest on; two baskets that share least items
    share their first common one within all but the last least - 1 of each, and are kept there alone. The places of that item in both say how many more they can share at most, which is asked before anything is compared.

    Where no item is held by very many (counted), pairs are counted instead: see counted_overlaps(). The pairs are the same.
    """
    by = within or []
    if counted:
        return counted_overlaps(baskets.where(F.col(item).isNotNull()), key, item, by, least)
    packed = baskets.where(F.col(item).isNotNull()).groupBy(*by, key).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") >= least)
    if largest is not None:
        fits = F.when(F.size("items") <= largest, F.col("items")).otherwise(F.raise_error(F.lit(f"a basket has over {largest} items")))
        keyed = packed.select(*by, key, fits.alias("items")).select(*by, key, "items", F.explode(subsets(F.col("items"), least)).alias("some"))
    else:
        held = packed.select(*by, key, F.explode("items").alias("item"))
        rare = held.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"))
        numbered = F.sort_array(F.collect_list(F.struct("n", "item")))
        ordered = held.join(rare, [*by, "item"]).groupBy(*by, key).agg(F.transform(numbered, lambda x: x["item"]).alias("items"))
        prefix = F.slice("items", 1, F.size("items") - (least - 1))
        keyed = ordered.select(*by, key, "items", F.posexplode(prefix).alias("at", "some"))
    a, b = (keyed.select(*by, "some", F.col(key).alias(k), *(F.col(c).alias(f"{c}_{k}") for c in keyed.columns if c in ("items", "at"))) for k in "ab")
    met = a.join(b, [*by, "some"]).where("a < b")
    if largest is not None:
        met = computed(met, both=F.array_sort(F.array_intersect("items_a", "items_b")))
        return met.where(F.slice("both", 1, least) == F.col("some")).select(*by, "a", "b", F.size("both").cast("long").alias("shared"))
    met = met.where(F.least(F.size("items_a") - F.col("at_a"), F.size("items_b") - F.col("at_b")) >= least)
    met = computed(met, both=F.array_intersect("items_a", "items_b"))  # in the order of a's items
    return met.where((F.size("both") >= least) & (F.get("both", 0) == F.col("some"))).select(*by, "a", "b", F.size("both").cast("long").alias("shared"))


def counted_overlaps(baskets: DataFrame, key: str, item: str, by: list[str], least: int) -> DataFrame:
    """overlaps() by counting: each holder of an item is sent the list of the later ones, so a pair is one number for each item it shares, and no basket is sent along or compared.

    A holder's lists in one order have those it shares least items with in runs of that length. An item of n holders costs n * n / 2 numbers: not for items that very many hold.
    """
    holders = baskets.groupBy(*by, item).agg(F.sort_array(F.collect_set(key)).alias("h")).where(F.size("h") > 1)
    later = holders.select(*by, "h", F.posexplode("h").alias("at", "a")).where(F.col("at") + 1 < F.size("h"))
    lists = later.select(*by, "a", F.slice("h", F.col("at") + 2, F.size("h")).alias("b")).groupBy(*by, "a").agg(F.flatten(F.collect_list("b")).alias("b")).where(F.size("b") >= least)
    met = computed(lists, b=F.sort_array("b"))
    other = lambda i: F.get("b", i)
    start = F.transform("b", lambda x, i: F.when((other(i + (least - 1)) == x) & ~other(i - 1).eqNullSafe(x), i))
    end = F.transform("b", lambda x, i: F.when((other(i - (least - 1)) == x) & ~other(i + 1).eqNullSafe(x), i))
    runs = F.arrays_zip(F.array_compact(start).alias("start"), F.array_compact(end).alias("end"))
    found = met.select(*by, "a", "b", F.inline(runs))
    return found.select(*by, "a", other(F.col("start")).alias("b"), (F.col("end") - F.col("start") + 1).cast("long").alias("shared"))


def without_overlaps(picks: DataFrame, pairs: DataFrame, key: str = "fund_id", within: list[str] | None = None) -> DataFrame:
    """picks (key, alpha_n, pos) without those that overlap a better one: higher alpha_n, or the same and an earlier pos. One that goes still knocks out others, so one anti join does it."""
    by = within or []
    both = pairs.select(*by, "a", "b").unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    me = picks.select(*by, F.col(key).alias("a"), F.col("alpha_n").alias("own"), F.col("pos").alias("own_pos"))
    other = picks.select(*by, F.col(key).alias("b"), F.col("alpha_n").alias("theirs"), F.col("pos").alias("their_pos"))
    beaten = both.join(me, [*by, "a"]).join(other, [*by, "b"]).where("theirs > own OR (theirs = own AND their_pos < own_pos)").select(*by, F.col("a").alias(key)).distinct()
    return picks.join(beaten, [*by, key], "left_anti")


def normalised(rows: DataFrame, by: list[str], amount: str, pos: str, out: str = "pct") -> DataFrame:
    """Adds out: shares of 100 with 1 digit, the rest that rounding leaves given to the largest (the first of equal ones); all zero if the sum is."""
    w = W.partitionBy(*by)
    total = F.sum(amount).over(w)
    share = F.when(total > 0, half_up(F.col(amount) / total * 100, 1)).otherwise(0.0)
    rows = rows.withColumns({"_total": total, "_share": share})
    first = F.row_number().over(w.orderBy(F.desc("_share"), pos)) == 1
    gap = half_up(100 - F.sum("_share").over(w), 1)
    pct = F.when(first & (F.col("_total") > 0), half_up(F.col("_share") + gap, 1)).otherwise(F.col("_share"))
    return rows.withColumn(out, pct).drop("_total", "_share")


def shares_of(amounts: Column, total: Column) -> Column:
    """Shares of 100 with 1 digit of an array of amounts that is one portfolio; all zero if the total is."""
    return F.transform(amounts, lambda x: F.when(total > 0, half_up(x / total * 100, 1)).otherwise(0.0))


def rounded_to_100(shares: Column, total: Column) -> Column:
    """shares_of() with the rest that rounding leaves given to the first of the largest."""
    gap = half_up(100 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), 1)
    first = F.array_position(shares, F.array_max(shares)) - 1
    bound = F.array(F.struct(gap.alias("gap"), first.alias("first")))  # computed once, not for each share
    return F.get(F.transform(bound, lambda g: F.transform(shares, lambda x, i: F.when((i == g["first"]) & (total > 0), half_up(x + g["gap"], 1)).otherwise(x))), 0)


def slice_bounds(rows: DataFrame, by: list[str], pct: str = "pct", pos: str = "pos") -> DataFrame:
    """Adds start and end of each slice that isn't zero; the last one ends at 100."""
    live = rows.where(F.col(pct) > 0)
    w = W.partitionBy(*by).orderBy(pos)
    end = half_up(F.sum(pct).over(w.rowsBetween(W.unboundedPreceding, 0)), 1)
    last = F.lead(F.lit(1)).over(w).isNull()
    live = live.withColumn("end", F.when(last, 100.0).otherwise(end))
    return live.withColumn("start", F.coalesce(F.lag("end").over(w), F.lit(0.0)))


def cap_and_spill(portfolios: DataFrame, shares: str = "shares", cap: str = "cap") -> DataFrame:
    """Adds capped: array<double> of the cores' shares cut to cap, and spill, what no core had room for (it goes to the first sleeve).

    Cores are taken in order: what one has over the cap goes to the others up to their room as it
    then is. An array is one portfolio, so there is no shuffle; it has a handful of entries.
    """

    def give(acc: Column, i: Column) -> Column:
        own = F.get(acc["p"], i)
        over = F.greatest(own - F.col(cap), F.lit(0.0))

        def fill(inner: Column, j: Column) -> Column:
            room = F.when(j == i, F.lit(0.0)).otherwise(F.greatest(F.col(cap) - F.get(acc["p"], j), F.lit(0.0)))
            take = F.least(room, inner["left"])
            return F.struct((inner["left"] - take).alias("left"), F.concat(inner["p"], F.array(F.when(j == i, F.least(own, F.col(cap))).otherwise(F.get(acc["p"], j) + take))).alias("p"))

        done = F.aggregate(F.sequence(F.lit(0), F.size(acc["p"]) - 1), F.struct(over.alias("left"), F.array().cast("array<double>").alias("p")), fill)
        return F.struct(done["p"].alias("p"), (acc["spill"] + done["left"]).alias("spill"))

    start = F.struct(F.col(shares).cast("array<double>").alias("p"), F.lit(0.0).alias("spill"))
    folded = F.aggregate(F.when(F.size(shares) > 0, F.sequence(F.lit(0), F.size(shares) - 1)).otherwise(F.array().cast("array<int>")), start, give)
    out = computed(portfolios, _f=folded)
    return out.select(*portfolios.columns, F.transform("_f.p", lambda x: half_up(x, 1)).alias("capped"), half_up("_f.spill", 1).alias("spill"))


def base_portfolio(scored: DataFrame, clients: DataFrame, sleeves: Mapping[str, str], templates: Mapping[str, tuple[float, float, float]] = TEMPLATES, cores: int = 2) -> DataFrame:
    """client_id, pos, fund (text), role, pct, alpha_n: the best cores, a gold sleeve and a money market sleeve for each client with any score.

    scored: client_id, fund_id, composite, alpha_n, efficiency_n, and structural where the table has it: funds that are structural are never cores. clients: client_id, profile, preference, and cap if cores are cut to one.
    templates has a profile's weights of the cores together, of gold and of the money market; sleeves the codes: gold, money_market, and money_market_screened for clients whose preference is true. Cores share their weight in
    proportion to their scores, in parts of 1 / cores where these sum to 0; weights are brought to 100 with 1 digit, and what rounding leaves is the largest holding's (the first of equals). A core
    over the cap then fills the other and then gold; see cap_and_spill(). One grouping by client, whose few holdings are an array. A profile without a template is an error of the query's data and gives no row.
    """
    free = scored.where(~F.coalesce("structural", F.lit(False))) if "structural" in scored.columns else scored
    best = best_of(free, cores)
    own = best.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("fund_id").cast("string").alias("fund"), F.col("composite").cast("double").alias("c"), "alpha_n"))).alias("own"))
    facts = clients.select("client_id", "profile", "preference", *(["cap"] if "cap" in clients.columns else []))
    part = lambda i: reduce(lambda out, kv: F.when(F.col("profile") == kv[0], F.lit(float(kv[1][i]))).otherwise(out), templates.items(), F.lit(None).cast("double"))
    own = own.join(facts, "client_id").withColumns({"core": part(0), "gold": part(1), "money": part(2)}).where("core IS NOT NULL")
    own = computed(own, total=F.aggregate("own", F.lit(0.0), lambda a, o: a + F.coalesce(o["c"], F.lit(0.0))))
    weight = lambda o: F.when(F.col("total") > 0, F.col("core") * F.coalesce(o["c"], F.lit(0.0)) / F.col("total")).otherwise(F.col("core") / cores)
    own = computed(own, raw=F.concat(F.transform("own", weight), F.array("gold", "money")))
    own = computed(own, whole=F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    own = computed(own, parts=shares_of(F.col("raw"), F.col("whole")))
    own = computed(own, pct=rounded_to_100(F.col("parts"), F.col("whole")))
    own, spill = own.withColumn("shares", F.slice("pct", 1, F.size("own"))), F.lit(0.0)
    if "cap" in clients.columns:
        own = own.withColumn("cap", F.col("cap").cast("double"))
        own, spill = cap_and_spill(own).drop("shares").withColumnRenamed("capped", "shares"), F.col("spill")
    row = lambda pos, fund, role, pct, alpha: F.struct(pos.cast("int").alias("pos"), fund.alias("fund"), F.lit(role).alias("role"), pct.alias("pct"), alpha.cast("double").alias("alpha_n"))
    held = F.transform("own", lambda o, i: row(o["position"], o["fund"], "core", F.get("shares", i), o["alpha_n"]))
    cash = F.when(F.coalesce("preference", F.lit(False)), sleeves["money_market_screened"]).otherwise(sleeves["money_market"])
    gold = row(F.lit(cores + 1), F.lit(sleeves["gold"]), STRUCTURAL_ROLES[0], half_up(F.get("pct", F.size("own")) + spill, 1), F.lit(None))
    money = row(F.lit(cores + 2), cash, STRUCTURAL_ROLES[1], F.get("pct", F.size("own") + 1), F.lit(None))
    return own.select("client_id", F.inline(F.concat(held, F.array(gold, money))))


def outlier_swap(portfolio: DataFrame, candidates: DataFrame, blocked: DataFrame | None = None, least: float = 80.0, top: int = 5, exempt: tuple[str, ...] = ("Aggressive",)) -> DataFrame:
    """The weakest core of each portfolio gives its share to the first of the top candidates that passes every gate.

    portfolio: client_id, profile, pos, fund, role, pct, alpha_n. candidates: client_id, fund, position, alpha_n, alpha_3y, alpha_5y,
    matches (the client's wish is met), and qualified where the table has it: those that aren't are no candidates at all.
    The candidates that aren't held are cut to top before the gates. Gates: 3-year alpha positive (null fails), 5-year alpha positive
    where known, alpha_n of least or more, matches, and no overlap (blocked: client_id, fund; see blocked_by()). Exempt profiles keep what they have.
    """
    held = portfolio.select("client_id", "fund")
    free = (candidates.where(F.coalesce("qualified", F.lit(False))) if "qualified" in candidates.columns else candidates).join(held, ["client_id", "fund"], "left_anti")
    free = free.withColumn("nth", F.row_number().over(W.partitionBy("client_id").orderBy("position"))).where(F.col("nth") <= top)
    good = free.where((F.col("alpha_3y") > 0) & F.coalesce(F.col("alpha_5y") > 0, F.lit(True)) & (F.col("alpha_n") >= least) & F.col("matches"))
    good = good if blocked is None else good.join(blocked, ["client_id", "fund"], "left_anti")
    pick = good.groupBy("client_id").agg(F.min_by(F.struct("fund", "alpha_n"), "nth").alias("pick"))
    return _swapped(portfolio, pick.select("client_id", F.col("pick.fund").alias("new_fund"), F.col("pick.alpha_n").alias("new_alpha")), "outlier", ~F.col("profile").isin(*exempt))


def blocked_by(portfolio: DataFrame, pairs: DataFrame) -> DataFrame:
    """client_id and fund of each fund that overlaps a held core: pairs (a, b) as overlaps() gives them."""
    both = pairs.select(F.col("a").cast("string").alias("core"), F.col("b").cast("string").alias("fund")).unionByName(pairs.select(F.col("b").cast("string").alias("core"), F.col("a").cast("string").alias("fund")))
    cores = portfolio.where("role = 'core'").select("client_id", F.col("fund").alias("core"))
    return cores.join(both, "core").select("client_id", "fund").distinct()


def gap_pick(candidates: DataFrame, portfolio: DataFrame | None = None, gaps: DataFrame | None = None, tie: str = "fund", by: str = "client_id") -> DataFrame:
    """by, new_fund and new_alpha: the candidate (by, fund, alpha_n, alpha_3y) with the greatest positive 3-year alpha, of equal ones the least by tie; with a portfolio none that is held, with gaps only their clients."""
    good = candidates.where(F.col("alpha_3y") > 0)
    good = good if portfolio is None else good.join(portfolio.select(by, "fund"), [by, "fund"], "left_anti")
    good = good if gaps is None else good.join(gaps.select(by).distinct(), by, "left_semi")
    best = good.groupBy(by).agg(F.min_by(F.struct("fund", "alpha_n"), F.struct(-F.col("alpha_3y"), F.col(tie))).alias("pick"))
    return best.select(by, F.col("pick.fund").alias("new_fund"), F.col("pick.alpha_n").alias("new_alpha"))


def gap_swap(portfolio: DataFrame, pick: DataFrame, gaps: DataFrame, most: float = 15.0, default_cap: float = 50.0) -> DataFrame:
    """Where gaps (client_id) are declared and no outlier is held, pick (client_id, new_fund, new_alpha; see gap_pick()) takes the weakest core's place with most at the most.

    What is freed goes to the other cores in proportion to their shares, in equal parts where these sum to 0; what rounding leaves goes to the
    largest holding (the first of equals). A core over its cap (column cap of portfolio, else default_cap) is then cut to it, and what it
    loses fills the other cores up to theirs and then the first sleeve; see cap_and_spill(). The new fund can be cut but is never filled. One shuffle by client: a portfolio is an array.
    """
    wanted = gaps.select("client_id").distinct().join(pick, "client_id")
    no_outlier = F.max(F.when(F.col("role") == "outlier", 1).otherwise(0)).over(W.partitionBy("client_id")) == 0
    out = _swapped(portfolio, wanted, "gap", no_outlier)
    columns = [c for c in out.columns if c != "client_id"]
    cap = F.col("cap").cast("double") if "cap" in columns else F.lit(default_cap)
    # core: 1, gap: 2, others: 0; arrays in the order of pos
    kind = F.when(F.col("role") == "core", 1).when(F.col("role") == "gap", 2).otherwise(0)
    book = out.withColumns({"_cap": cap, "_kind": kind, "_pct": F.col("pct").cast("double")}).groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*columns).alias("row"), F.col("_pct").alias("p"), F.col("_kind").alias("k")))).alias("h"), F.max("_cap").alias("cap"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    freed = total("h", lambda x: F.when(x["k"] == 2, F.greatest(x["p"] - most, F.lit(0.0))).otherwise(0.0))
    core_sum, cores = total("h", lambda x: F.when(x["k"] == 1, x["p"]).otherwise(0.0)), F.size(F.filter("h", lambda x: x["k"] == 1))
    book = computed(book, freed=freed, core_sum=core_sum, cores=cores, swapped=F.exists("h", lambda x: x["k"] == 2))
    part = lambda x: half_up(x["p"] + F.when(F.col("core_sum") > 0, F.col("freed") * x["p"] / F.col("core_sum")).otherwise(F.col("freed") / F.col("cores")), 1)
    moved = F.transform("h", lambda x: F.when(x["k"] == 2, F.least(x["p"], F.lit(most))).when((x["k"] == 1) & (F.col("freed") > 0), part(x)).otherwise(x["p"]))
    book = computed(book, p=F.when(F.col("swapped"), moved).otherwise(F.transform("h", lambda x: x["p"])))
    rest = F.when(F.col("swapped"), half_up(100 - total("p", lambda x: x), 1)).otherwise(0.0)
    book = computed(book, rest=rest, largest=F.array_position("p", F.array_max("p")) - 1)
    book = computed(book, p=F.transform("p", lambda x, i: F.when((i == F.col("largest")) & (F.col("rest") != 0), half_up(x + F.col("rest"), 1)).otherwise(x)))
    sleeve = F.get(F.filter(F.transform("h", lambda x, i: F.when(x["k"] == 0, i)), lambda i: i.isNotNull()), 0)
    # without a sleeve that could take what is over, nothing is cut
    book = computed(book, sleeve=F.when(F.col("swapped"), sleeve))
    book = cap_and_spill(computed(book, shares=F.filter("p", lambda x, i: F.col("sleeve").isNotNull() & (F.get("h", i)["k"] == 1))))
    nth = lambda i: F.size(F.filter(F.slice("h", 1, i + 1), lambda x: x["k"] == 1)) - 1
    over = F.aggregate(F.filter("p", lambda x, i: F.get("h", i)["k"] == 2), F.lit(0.0), lambda t, x: t + F.greatest(x - F.col("cap"), F.lit(0.0)))
    final = F.transform("p", lambda x, i: F.when(F.col("sleeve").isNull(), x).when(F.get("h", i)["k"] == 1, F.get("capped", nth(i))).when(F.get("h", i)["k"] == 2, F.least(x, F.col("cap"))).when(i == F.col("sleeve"), half_up(x + F.col("spill") + over, 1)).otherwise(x))
    book = computed(book, p=final)
    rows = book.select("client_id", F.inline(F.transform("h", lambda x, i: F.struct(x["row"].alias("row"), F.get("p", i).alias("p")))))
    return rows.select(*(F.col("p").alias("pct") if c == "pct" else F.col("client_id") if c == "client_id" else F.col(f"row.{c}").alias(c) for c in portfolio.columns))


def _swapped(portfolio: DataFrame, pick: DataFrame, role: str, allowed: Column) -> DataFrame:
    core = F.when(F.col("role") == "core", F.struct(F.coalesce("alpha_n", F.lit(0.0)), F.col("pos")))
    weakest = F.min(core).over(W.partitionBy("client_id"))
    rows = portfolio.withColumns({"_allowed": allowed, "_weak": core.eqNullSafe(weakest) & core.isNotNull()}).join(pick, "client_id", "left")
    swap = F.col("_weak") & F.col("_allowed") & F.col("new_fund").isNotNull()
    put = lambda name, new: F.when(swap, new).otherwise(F.col(name)).alias(name)
    changed = {"fund": put("fund", F.col("new_fund")), "role": put("role", F.lit(role)), "alpha_n": put("alpha_n", F.col("new_alpha"))}
    return rows.select(*(changed.get(c, F.col(c)) for c in portfolio.columns))


def edited(portfolio: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits (client_id, pos, fund, pct) in the place of a client's holdings, with roles kept where the fund was held; and the edits without a fund or a share, whose clients keep their portfolio."""
    bad = edits.where(F.col("fund").isNull() | F.col("pct").isNull())
    good = edits.join(bad.select("client_id").distinct(), "client_id", "left_anti")
    facts = portfolio.select("client_id", "fund", "role", "alpha_n")
    new = good.join(facts, ["client_id", "fund"], "left").select("client_id", "pos", "fund", F.coalesce("role", F.lit("core")).alias("role"), "pct", "alpha_n")
    old = portfolio.join(good.select("client_id").distinct(), "client_id", "left_anti").select("client_id", "pos", "fund", "role", "pct", "alpha_n")
    return old.unionByName(new), bad
