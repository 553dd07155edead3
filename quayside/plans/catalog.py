"""Registered queries over the driver's tables. QUERIES: name -> (spark, sf_dir) -> DataFrame; SQL: name -> the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quayside.functions import scalars as S
from quayside.functions.ranks import matched
from quayside.operators import checks, exposure, extraction, master, measures, nav, portfolio, scoring, screening, summaries
from quayside.plans import standins as V
from quayside.plans.standins import VIEWS, exact, table
from quayside.sources import stored, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2030-01-01"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must give the same rows; the views of standins are in reach of it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else exact(VIEWS + sql)
        return f

    return keep


@query("SELECT fund_id, period, fund_ret, bench_ret, alpha, beat FROM alpha_v")
def period_alpha(spark, sf_dir):
    return V.alphas(spark, sf_dir).select("fund_id", "period", "fund_ret", "bench_ret", "alpha", "beat")


@query("SELECT fund_id, weighted_alpha, out_periods, total_periods, rate, qualified FROM screened_v")
def weighted_alpha_screen(spark, sf_dir):
    return V.screened(spark, sf_dir).select("fund_id", "weighted_alpha", "out_periods", "total_periods", "rate", "qualified")


@query("""SELECT fund_id, CASE WHEN qualified THEN 'Qualified' ELSE 'Disqualified' END || ': ' || coalesce(printf('%+.2f', round(weighted_alpha, 2)), 'N/A') || ' (' || coalesce(nullif(concat_ws(', ',
CASE WHEN alpha_1y > 0 THEN '1y up' WHEN alpha_1y IS NOT NULL THEN '1y down' END, CASE WHEN alpha_3y > 0 THEN '3y up' WHEN alpha_3y IS NOT NULL THEN '3y down' END), ''), 'N/A') || ')' AS rationale FROM screened_v JOIN wide_v USING (fund_id)""")
def screen_rationale(spark, sf_dir):
    rows = V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir), "fund_id")
    status = F.when(F.col("qualified"), "Qualified").otherwise("Disqualified")
    return rows.select("fund_id", screening.rationale(status, F.col("weighted_alpha"), {p: F.col(f"alpha_{p}") for p in ("1y", "3y")}).alias("rationale"))


@query("SELECT fund_id, blend_ret AS blended, alpha, efficiency FROM measured_v JOIN blend_v USING (fund_id)".replace("alpha, eff", "measured_v.alpha, measured_v.eff"))
def blend_penalised(spark, sf_dir):
    return V.measured(spark, sf_dir).select("fund_id", "blended", "alpha", "efficiency")


@query("""SELECT coalesce(fund_type, 'Total') AS fund_type, count(*) FILTER (WHERE qualified) AS qualified, count(*) FILTER (WHERE qualified AND rate = 100) AS beat_all, count(*) FILTER (WHERE qualified AND screened) AS screened,
count(*) FILTER (WHERE qualified AND NOT screened) AS conventional FROM screened_v GROUP BY ROLLUP (fund_type)""")
def type_counts(spark, sf_dir):
    return summaries.type_counts(V.screened(spark, sf_dir))


MEDIANS = {**{f"ret_{p}": 4 for p in V.PERIODS}, "alpha_3y": 4, "rate": 2}


@query("SELECT fund_type, " + ", ".join(f"round(median({c}), {d}) AS {c}" for c, d in MEDIANS.items()) + " FROM screened_v JOIN wide_v USING (fund_id) WHERE qualified GROUP BY 1")
def type_medians(spark, sf_dir):
    return summaries.type_medians(V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir).drop("class"), "fund_id"), MEDIANS)


TOPS = ["ret_3y", "alpha_3y", "efficiency_3y", "size"]


@query("""SELECT fund_type, measure, rank, fund_id, value FROM (SELECT *, row_number() OVER (PARTITION BY fund_type, measure ORDER BY value DESC, fund_id)::INTEGER AS rank FROM (SELECT fund_type, fund_id, unnest(['ret_3y', 'alpha_3y', 'efficiency_3y', 'size']) AS measure,
unnest([ret_3y, alpha_3y, alpha_3y / (risk_level * 2.0::DOUBLE), p_retailprice]) AS value FROM screened_v JOIN wide_v USING (fund_id) JOIN part ON p_partkey = fund_id WHERE qualified) WHERE value IS NOT NULL) WHERE rank <= 5""")
def top5_per_type(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fund_id"), F.col("p_retailprice").alias("size"))
    rows = V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir).drop("class"), "fund_id").join(facts, "fund_id")
    return summaries.top_by_type(rows.withColumn("efficiency_3y", measures.efficiency(F.col("alpha_3y"), F.col("risk_level") * F.lit(2.0))), TOPS)


@query("SELECT count(*) AS funds, count(*) FILTER (WHERE qualified) AS qualified, count(*) FILTER (WHERE NOT qualified) AS disqualified, round(count(*) FILTER (WHERE qualified) / count(*) * 100, 1) AS pass_rate, count(alpha_3y) AS with_alpha_3y, count(alpha_10y) AS with_alpha_10y FROM screened_v JOIN wide_v USING (fund_id)")
def screening_counts(spark, sf_dir):
    return summaries.screening_counts(V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir), "fund_id"), ["alpha_3y", "alpha_10y"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE length(trim(text)) > 0) AS text, count(lang) FILTER (WHERE length(trim(lang)) > 0) AS lang, count(n_chars) AS n_chars, count(*) FILTER (WHERE len(words) > 0) AS words FROM (SELECT *, list_filter(string_split(coalesce(text, ''), ' '), lambda w: contains(w, '9')) AS words FROM documents)")
def completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("words", F.filter(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: w.contains("9")))
    return summaries.completeness(rows, ["text", "lang", "n_chars", "words"])


#: Types come in this order, all others after them.
TYPE_ORDER = ("STANDARD", "ECONOMY", "SMALL", "PROMO")


@query(f"SELECT fund_id, row_number() OVER (ORDER BY qualified DESC, coalesce(list_position({list(TYPE_ORDER)}, fund_type), 9), coalesce(weighted_alpha, 0) DESC, coalesce(alpha_3y, 0) DESC, fund_id)::BIGINT AS position FROM screened_v JOIN wide_v USING (fund_id)")
def master_order(spark, sf_dir):
    rows = V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir).select("fund_id", "alpha_3y"), "fund_id")
    return screening.ranked_order(rows.select("fund_id", "fund_type", "qualified", "weighted_alpha", "alpha_3y"), TYPE_ORDER).select("fund_id", "position")


@query(f"""SELECT fund_id, round(a.nav, 4) AS ath_nav, ath_date::VARCHAR AS ath_date, round(current_nav, 4) AS current_nav, points, CASE WHEN a.nav > 0 THEN round((current_nav - a.nav) / a.nav * 100, 2) END AS drawdown_pct, datediff('day', ath_date, DATE '{AS_OF}')::INTEGER AS days_from_ath
FROM (SELECT fund_id, max(nav) AS nav, arg_max(nav, nav_date) AS current_nav, count(*) AS points FROM nav_v GROUP BY 1) a JOIN (SELECT v.fund_id, min(nav_date) AS ath_date FROM nav_v v JOIN (SELECT fund_id, max(nav) AS top FROM nav_v GROUP BY 1) m ON v.fund_id = m.fund_id AND v.nav = m.top GROUP BY 1) d USING (fund_id)""")
def ath_full(spark, sf_dir):
    state = nav.drawdown(nav.all_time_high(V.prices(spark, sf_dir)), F.lit(AS_OF).cast("date"))
    return state.select("fund_id", "ath_nav", F.col("ath_date").cast("string").alias("ath_date"), "current_nav", "points", "drawdown_pct", "days_from_ath")


@query(SQL["ath_full"])
def ath_incremental(spark, sf_dir):
    """Days up to the middle of the history as state, the rest merged from points after it: the same as ath_full."""
    points = V.prices(spark, sf_dir)
    old, rest = nav.halves(points)
    new = nav.all_time_high(rest)
    state = nav.drawdown(nav.merged(old, new), F.lit(AS_OF).cast("date"))
    return state.select("fund_id", "ath_nav", F.col("ath_date").cast("string").alias("ath_date"), "current_nav", "points", "drawdown_pct", "days_from_ath")


@query(SQL["ath_full"].replace("SELECT fund_id, round((a.nav)", ", ath AS (SELECT fund_id, round((a.nav)", 1) + """)
SELECT count(*) FILTER (WHERE drawdown_pct >= -1) AS at_high, count(*) FILTER (WHERE drawdown_pct >= -10 AND drawdown_pct < -1) AS shallow, count(*) FILTER (WHERE drawdown_pct >= -20 AND drawdown_pct < -10) AS middling, count(*) FILTER (WHERE drawdown_pct < -20) AS deep,
count(*) FILTER (WHERE days_from_ath <= 30) AS recent, list_sort(list(drawdown_pct))[len(list(drawdown_pct)) // 2 + 1] AS upper_median FROM ath""")
def drawdown_summary(spark, sf_dir):
    return nav.drawdown_summary(ath_full(spark, sf_dir)).select("at_high", "shallow", "middling", "deep", "recent", "upper_median")


@query("SELECT client_id, profile, target_pct, mid, ceiling, w_alpha, w_returnfit, w_efficiency, w_momentum, CASE WHEN target_pct > high THEN printf('target %.1f is over %.1f', target_pct, high) END AS warning FROM weighted_v")
def profile_weights(spark, sf_dir):
    rows = scoring.profile_weights(V.clients(spark, sf_dir))
    return rows.select("client_id", "profile", "target_pct", "mid", "ceiling", *(f"w_{m}" for m in scoring.MEASURES), "warning")


@query("SELECT client_id, n AS funds FROM weighted_v w JOIN (SELECT ceiling, preference, count(*) AS n FROM universe_v GROUP BY 1, 2) u ON w.ceiling = u.ceiling AND w.preference IS NOT DISTINCT FROM u.preference")
def client_universe_counts(spark, sf_dir):
    clients = scoring.with_defaults(V.clients(spark, sf_dir))
    counts = scoring.universes(clients, V.measured(spark, sf_dir)).groupBy(F.col("ceiling").alias("c"), F.col("preference").alias("p")).agg(F.count(F.lit(1)).alias("funds"))
    return clients.join(counts, (F.col("ceiling") == F.col("c")) & F.col("preference").eqNullSafe(F.col("p"))).select("client_id", "funds")


@query("SELECT ceiling, coalesce(preference::VARCHAR, 'any') AS preference, class, fund_id, alpha_n, efficiency_n FROM member_v")
def class_percentile(spark, sf_dir):
    clients = scoring.with_defaults(V.clients(spark, sf_dir))
    members = scoring.universes(clients, _measured(spark, sf_dir))
    rows = scoring.class_percentiles(members, ["ceiling", "preference", "class"], {"alpha_n": "alpha", "efficiency_n": "efficiency"})
    wish = F.coalesce(F.col("preference").cast("string"), F.lit("any")).alias("preference")
    return rows.select("ceiling", wish, "class", "fund_id", "alpha_n", "efficiency_n")


def _measured(spark, sf_dir):
    """What scoring needs of each fund, computed once: ranks and scores read it several times, and it is small next to the sales that it comes from."""
    return V.settled(V.measured(spark, sf_dir))


def _kinds(spark, sf_dir):
    """Clients that differ in nothing that scores depend on are one kind; kind is its number."""
    key = F.xxhash64("profile", "target_pct", F.coalesce(F.col("preference").cast("int"), F.lit(-1)))
    return V.clients(spark, sf_dir).withColumn("kind", key)


def _scored_kinds(spark, sf_dir, k: int):
    kinds = _kinds(spark, sf_dir).select(F.col("kind").alias("client_id"), "profile", "target_pct", "preference").distinct()
    return scoring.best_of(scoring.scores(kinds, _measured(spark, sf_dir)), k).withColumnRenamed("client_id", "kind")


@query("SELECT client_id, fund_id, composite, alpha_n, returnfit_n, efficiency_n, momentum_n, position FROM client_v c JOIN ranked_v r ON c.profile = r.profile AND c.target_pct = r.target_pct AND c.preference IS NOT DISTINCT FROM r.preference WHERE position <= 5")
def score_rank(spark, sf_dir):
    """The five best funds of every client, scored once for each kind of client."""
    best = _scored_kinds(spark, sf_dir, 5).drop("profile")
    return _kinds(spark, sf_dir).join(best, "kind").select("client_id", "fund_id", "composite", "alpha_n", "returnfit_n", "efficiency_n", "momentum_n", "position")


@query(""", swept AS (SELECT profile, target_pct, preference, fund_id, composite, alpha_n, efficiency_n, CASE WHEN lag(composite) OVER k - composite > 2 THEN 1 ELSE 0 END AS opens FROM score_v WINDOW k AS (PARTITION BY profile, target_pct, preference ORDER BY composite DESC, fund_id)),
banded AS (SELECT *, (1 + sum(opens) OVER (PARTITION BY profile, target_pct, preference ORDER BY composite DESC, fund_id ROWS UNBOUNDED PRECEDING))::INTEGER AS band FROM swept)
SELECT profile, target_pct, coalesce(preference::VARCHAR, 'any') AS preference, fund_id, composite, band, row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY band, alpha_n DESC, efficiency_n DESC, fund_id)::INTEGER AS position FROM banded""")
def score_rank_banded(spark, sf_dir):
    """All funds of each kind of client in bands: composites that follow each other within two points count as equal."""
    kinds = _kinds(spark, sf_dir).select(F.col("kind").alias("client_id"), "profile", "target_pct", "preference").distinct()
    out = scoring.ranked_bands(scoring.scores(kinds, _measured(spark, sf_dir)))
    wish = F.coalesce(F.col("preference").cast("string"), F.lit("any")).alias("preference")
    return out.drop("profile").join(kinds, "client_id").select("profile", "target_pct", wish, "fund_id", "composite", "band", "position")


@query()
def score_rank_compared(spark, sf_dir):
    """The same by comparison of pairs, in which composites within two points count as equal; the order isn't transitive, so no SQL gives it."""
    kinds = _kinds(spark, sf_dir).select(F.col("kind").alias("client_id"), "profile", "target_pct", "preference").distinct()
    return scoring.ranked_banded(scoring.scores(kinds, _measured(spark, sf_dir))).withColumnRenamed("client_id", "kind")


@query("SELECT profile, target_pct, coalesce(preference::VARCHAR, 'any') AS preference, fund_id, x AS ratio, returnfit_n FROM fit_v WHERE NOT all_negative".replace("x AS ratio", "round(x, 6) AS ratio"))
def piecewise_fit(spark, sf_dir):
    clients = scoring.with_defaults(V.clients(spark, sf_dir)).select("profile", "target", "target_pct", "preference", "ceiling").distinct()
    members, by = scoring.universes(clients, _measured(spark, sf_dir)), ["ceiling", "preference", "class"]
    members = matched(members, scoring.all_negative(members, by), by).where(~F.col("all_negative")).withColumnsRenamed({"ceiling": "c", "preference": "p"})
    met = clients.join(members, (F.col("ceiling") == F.col("c")) & F.col("preference").eqNullSafe(F.col("p")))
    ratio = measures.return_ratio(F.col("blended"), F.col("target"))
    wish = F.coalesce(F.col("preference").cast("string"), F.lit("any")).alias("preference")
    return met.select("profile", "target_pct", wish, "fund_id", S.half_up(ratio, 6).alias("ratio"), S.piecewise(ratio).alias("returnfit_n"))


PAIRS = "pairs AS (SELECT x.fund_id AS a, y.fund_id AS b, count(*) AS shared FROM basket_v x JOIN basket_v y ON x.item = y.item AND x.fund_id < y.fund_id GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(", " + PAIRS + " SELECT a, b, shared FROM pairs")
def overlap_pairs(spark, sf_dir):
    return portfolio.overlaps(V.baskets(spark, sf_dir), largest=5)


@query(""", bought AS (SELECT DISTINCT o_custkey AS client, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT x.client AS a, y.client AS b, count(*) AS shared FROM bought x JOIN bought y ON x.item = y.item AND x.client < y.client GROUP BY 1, 2 HAVING count(*) >= 4""")
def customer_overlaps(spark, sf_dir):
    """Customers who have bought four or more of the same parts; a customer's parts are a basket of any size. Lists of a part's buyers are counted, unless a few parts are bought so often that these would be long."""
    sold = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL").groupBy("l_partkey").count().agg(F.sum(F.col("count").cast("double") ** 2) / F.sum("count")).first()[0]
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("client"), F.col("l_partkey").alias("item"))
    return portfolio.overlaps(bought, "client", "item", least=4, counted=(sold or 0) <= 1_000)


@query(", " + PAIRS + """, picks AS (SELECT s_suppkey AS fund_id, round(s_acctbal, 0) AS alpha_n, s_suppkey AS pos FROM supplier), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)
SELECT fund_id, alpha_n FROM picks WHERE fund_id NOT IN (SELECT me.fund_id FROM both_ways JOIN picks me ON a = me.fund_id JOIN picks o ON b = o.fund_id WHERE o.alpha_n > me.alpha_n OR (o.alpha_n = me.alpha_n AND o.pos < me.pos))""")
def overlap_dedup(spark, sf_dir):
    picks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fund_id"), S.half_up("s_acctbal", 0).alias("alpha_n"), F.col("s_suppkey").alias("pos"))
    return portfolio.without_overlaps(picks, portfolio.overlaps(V.baskets(spark, sf_dir), largest=5)).select("fund_id", "alpha_n")


NORMAL = """, shares AS (SELECT portfolio_id, fund_id, amount, round(amount::DOUBLE / (sum(amount) OVER (PARTITION BY portfolio_id))::DOUBLE * 100, 1) AS s FROM holding_v),
firsts AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY s DESC, fund_id) AS nth, round(100 - sum(s) OVER (PARTITION BY portfolio_id), 1) AS gap FROM shares),
normal AS (SELECT portfolio_id, fund_id, CASE WHEN nth = 1 THEN round(s + gap, 1) ELSE s END AS pct FROM firsts)"""


@query(NORMAL + " SELECT portfolio_id, fund_id, pct FROM normal")
def normalise_residual(spark, sf_dir):
    rows = V.holdings(spark, sf_dir).withColumn("amount", F.col("amount").cast("double"))
    return portfolio.normalised(rows, ["portfolio_id"], "amount", "fund_id").select("portfolio_id", "fund_id", "pct")


@query(NORMAL + """, live AS (SELECT *, round(sum(pct) OVER (PARTITION BY portfolio_id ORDER BY fund_id ROWS UNBOUNDED PRECEDING), 1) AS run, lead(1) OVER (PARTITION BY portfolio_id ORDER BY fund_id) IS NULL AS last FROM normal WHERE pct > 0)
SELECT portfolio_id, fund_id, coalesce(lag(run) OVER (PARTITION BY portfolio_id ORDER BY fund_id), 0.0) AS start, CASE WHEN last THEN 100.0 ELSE run END AS "end" FROM live""")
def slice_bounds(spark, sf_dir):
    return portfolio.slice_bounds(normalise_residual(spark, sf_dir), ["portfolio_id"], pos="fund_id").select("portfolio_id", "fund_id", "start", "end")


@query(NORMAL + """, two AS (SELECT portfolio_id, max(pct) FILTER (WHERE n = 1) AS a, max(pct) FILTER (WHERE n = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY pct DESC, fund_id) AS n FROM normal) GROUP BY 1 HAVING count(*) >= 2)
SELECT portfolio_id, round(least(a, 50) + least(greatest(b - 50, 0), greatest(50 - least(a, 50), 0)), 1) AS core_1, round(least(b + least(greatest(a - 50, 0), greatest(50 - b, 0)), 50), 1) AS core_2, round(greatest(a - 50, 0) - least(greatest(a - 50, 0), greatest(50 - b, 0)), 1) AS spill FROM two""")
def cap_and_spill(spark, sf_dir):
    rows = normalise_residual(spark, sf_dir)
    nth = F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("pct"), "fund_id"))
    two = rows.withColumn("n", nth).where("n <= 2").groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("n", "pct"))).alias("cores")).where(F.size("cores") == 2)
    out = portfolio.cap_and_spill(two.select("portfolio_id", F.transform("cores", lambda c: c["pct"]).alias("shares"), F.lit(50.0).alias("cap")))
    return out.select("portfolio_id", F.get("capped", 0).alias("core_1"), F.get("capped", 1).alias("core_2"), "spill")


#: Every 25th fund is said to be structural. The sleeves are funds that no part stands for.
BASE = """, tmpl_v(profile, core, gold, mm) AS (VALUES ('Conservative', 63.5::DOUBLE, 6.5::DOUBLE, 17.5::DOUBLE), ('Moderate', 63.5, 9.0, 13.5), ('Moderately Aggressive', 67.5, 9.0, 11.0), ('Aggressive', 73.0, 10.0, 10.0)),
best AS (SELECT * FROM (SELECT profile, target_pct, preference, fund_id, composite, alpha_n, row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY position)::INTEGER AS position FROM ranked_v WHERE fund_id % 25 <> 0) WHERE position <= 2),
core_raw AS (SELECT b.*, CASE WHEN sum(composite) OVER k > 0 THEN core * composite / sum(composite) OVER k ELSE core / 2 END AS raw FROM best b JOIN tmpl_v USING (profile) WINDOW k AS (PARTITION BY profile, target_pct, preference)),
parts AS (SELECT profile, target_pct, preference, position AS pos, fund_id::VARCHAR AS fund, 'core' AS role, raw, alpha_n FROM core_raw
UNION ALL SELECT DISTINCT profile, target_pct, preference, 3, 'GOLD', 'structural:gold', gold, NULL::DOUBLE FROM best JOIN tmpl_v USING (profile)
UNION ALL SELECT DISTINCT profile, target_pct, preference, 4, CASE WHEN preference THEN 'CASH-S' ELSE 'CASH-C' END, 'structural:money_market', mm, NULL::DOUBLE FROM best JOIN tmpl_v USING (profile)),
sh AS (SELECT *, round(raw / sum(raw) OVER (PARTITION BY profile, target_pct, preference) * 100, 1) AS s FROM parts),
fixed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY s DESC, pos) = 1 THEN round(s + round(100 - sum(s) OVER (PARTITION BY profile, target_pct, preference), 1), 1) ELSE s END AS p FROM sh),
two AS (SELECT profile, target_pct, preference, cap, max(p) FILTER (WHERE pos = 1) AS a, max(p) FILTER (WHERE pos = 2) AS b FROM fixed JOIN profile_v USING (profile) GROUP BY 1, 2, 3, 4),
one AS (SELECT *, least(a, cap) AS a1, b + least(greatest(a - cap, 0), greatest(cap - b, 0)) AS b1, greatest(a - cap, 0) - coalesce(least(greatest(a - cap, 0), greatest(cap - b, 0)), 0) AS left1 FROM two),
capped AS (SELECT *, round(a1 + coalesce(least(greatest(b1 - cap, 0), greatest(cap - a1, 0)), 0), 1) AS core1, round(least(b1, cap), 1) AS core2, round(left1 + coalesce(greatest(b1 - cap, 0) - least(greatest(b1 - cap, 0), greatest(cap - a1, 0)), 0), 1) AS spill FROM one),
kind_base AS (SELECT f.profile, f.target_pct, f.preference, pos, fund, role, CASE pos WHEN 1 THEN core1 WHEN 2 THEN core2 WHEN 3 THEN round(p + spill, 1) ELSE p END AS pct, alpha_n FROM fixed f JOIN capped c ON f.profile = c.profile AND f.target_pct = c.target_pct AND f.preference IS NOT DISTINCT FROM c.preference)"""
SLEEVES = {"gold": "GOLD", "money_market": "CASH-C", "money_market_screened": "CASH-S"}
#: The rows of all clients from those of their kind, in a relation {0}.
OF_CLIENTS = " SELECT client_id, pos, fund, role, pct, alpha_n FROM client_v c JOIN {0} b ON c.profile = b.profile AND c.target_pct = b.target_pct AND c.preference IS NOT DISTINCT FROM b.preference"


def _book(spark, sf_dir, scored=None):
    """Base portfolios of the kinds of client (client_id: the kind), with their profile, cap and wish. What clients of one kind hold is the same, so substitutions are made for kinds as well, from the same scores."""
    kinds = _kinds(spark, sf_dir).select(F.col("kind").alias("client_id"), "profile", "target_pct", "preference").distinct()
    scored = scoring.scores(kinds, _measured(spark, sf_dir)) if scored is None else scored
    facts = kinds.select("client_id", "profile", "preference", scoring.profile_value(F.col("profile"), 3).alias("cap"))
    base = portfolio.base_portfolio(scored.withColumn("structural", F.col("fund_id") % 25 == 0), facts, SLEEVES)
    return base.join(facts, "client_id")


def _of_clients(spark, sf_dir, book):
    rows = book.select(F.col("client_id").alias("kind"), "pos", "fund", "role", "pct", "alpha_n")
    return _kinds(spark, sf_dir).select("client_id", "kind").join(rows, "kind").drop("kind")


@query(BASE + OF_CLIENTS.format("kind_base"))
def base_portfolio(spark, sf_dir):
    return _of_clients(spark, sf_dir, _book(spark, sf_dir))


def _scored_with_facts(spark, sf_dir):
    """The scores of all funds for all kinds, with what the substitutions ask of a fund."""
    kinds = _kinds(spark, sf_dir).select(F.col("kind").alias("client_id"), "profile", "target_pct", "preference").distinct()
    facts = V.screened(spark, sf_dir).select("fund_id", "qualified").join(V.wide_alphas(spark, sf_dir).select("fund_id", "alpha_3y", "alpha_5y"), "fund_id")
    return V.settled(scoring.scores(kinds, _measured(spark, sf_dir)).join(facts, "fund_id", "left"))


#: Every seventh fund is said not to be of the wanted kind. Funds overlap where three of the five places that most of them is in are the same.
SWAP = BASE + """, wanted AS (SELECT *, row_number() OVER (PARTITION BY r.profile, r.target_pct, r.preference ORDER BY composite DESC, alpha_n DESC, efficiency_n DESC, fund_id) AS qposition FROM ranked_v r JOIN screened_v USING (fund_id) WHERE qualified),
cand AS (SELECT r.profile, r.target_pct, r.preference, r.fund_id::VARCHAR AS fund, qposition, r.alpha_n, w.alpha_3y, w.alpha_5y, r.fund_id % 7 <> 0 AS matches FROM wanted r LEFT JOIN wide_v w ON w.fund_id = r.fund_id WHERE qposition <= 7),
free AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM kind_base b WHERE b.profile = c.profile AND b.target_pct = c.target_pct AND b.preference IS NOT DISTINCT FROM c.preference AND b.fund = c.fund)),
top AS (SELECT *, row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY qposition) AS nth FROM free),
token_v AS (SELECT fund_id::VARCHAR AS fund, place AS item FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY share DESC, place) AS n FROM geo_v) WHERE n <= 5),
hit AS (SELECT t.profile, t.target_pct, t.preference, t.fund FROM top t JOIN kind_base b ON b.profile = t.profile AND b.target_pct = t.target_pct AND b.preference IS NOT DISTINCT FROM t.preference AND b.role = 'core' JOIN token_v x ON x.fund = t.fund JOIN token_v y ON y.fund = b.fund AND x.item = y.item WHERE nth <= 5 GROUP BY 1, 2, 3, 4, b.fund HAVING count(*) >= 3),
pick AS (SELECT profile, target_pct, preference, arg_min(fund, nth) AS new_fund, arg_min(alpha_n, nth) AS new_alpha FROM top t WHERE nth <= 5 AND alpha_3y > 0 AND coalesce(alpha_5y > 0, true) AND alpha_n >= 80 AND matches
         AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.profile = t.profile AND h.target_pct = t.target_pct AND h.preference IS NOT DISTINCT FROM t.preference AND h.fund = t.fund) GROUP BY 1, 2, 3),
weak AS (SELECT *, role = 'core' AND row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY (role = 'core') DESC, coalesce(alpha_n, 0), pos) = 1 AS weakest FROM kind_base),
swapped AS (SELECT w.profile, w.target_pct, w.preference, pos, CASE WHEN weakest AND w.profile <> 'Aggressive' AND new_fund IS NOT NULL THEN new_fund ELSE fund END AS fund, CASE WHEN weakest AND w.profile <> 'Aggressive' AND new_fund IS NOT NULL THEN 'outlier' ELSE role END AS role, pct,
            CASE WHEN weakest AND w.profile <> 'Aggressive' AND new_fund IS NOT NULL THEN new_alpha ELSE alpha_n END AS alpha_n FROM weak w LEFT JOIN pick p ON p.profile = w.profile AND p.target_pct = w.target_pct AND p.preference IS NOT DISTINCT FROM w.preference)"""


def _tokens(spark, sf_dir):
    """The five places where most of a fund is, as its top holdings."""
    nth = F.row_number().over(W.partitionBy("fund_id").orderBy(F.desc("share"), "place"))
    return V.places(spark, sf_dir).withColumn("n", nth).where("n <= 5").select("fund_id", F.col("place").alias("item"))


def _swapped(spark, sf_dir, scored):
    """The book of these scores after the outlier's substitution: qualified funds only, every seventh fund isn't of the wanted kind, and none that shares three of its top places with a held core."""
    book = V.settled(_book(spark, sf_dir, scored))
    cand = scoring.best_of(scored.where("qualified"), 5 + 2)  # those that aren't held are cut to five by the operator, and no more than two are
    cand = cand.select("client_id", F.col("fund_id").cast("string").alias("fund"), "position", "alpha_n", "alpha_3y", "alpha_5y", (F.col("fund_id") % 7 != 0).alias("matches"), "qualified")
    cand = V.settled(cand)
    # only baskets of funds that are held or asked for meet; those are a few for each kind
    asked = cand.select("fund").unionByName(book.where("role = 'core'").select("fund")).distinct()
    tokens = _tokens(spark, sf_dir).withColumn("fund", F.col("fund_id").cast("string")).join(asked, "fund", "left_semi")
    blocked = portfolio.blocked_by(book, portfolio.overlaps(tokens, "fund", largest=5))
    return portfolio.outlier_swap(book, cand, blocked)


@query(SWAP + OF_CLIENTS.format("swapped"))
def outlier_swap(spark, sf_dir):
    return _of_clients(spark, sf_dir, _swapped(spark, sf_dir, _scored_with_facts(spark, sf_dir)))


#: The outlier's share is its core's; a gap is declared by clients without a preference, and the aggressive ones have no outlier.
GAP = SWAP + """, gap_cand AS (SELECT r.profile, r.target_pct, r.preference, r.fund_id::VARCHAR AS fund, r.alpha_n, w.alpha_3y FROM ranked_v r JOIN wide_v w USING (fund_id) WHERE r.preference IS NULL AND w.alpha_3y > 0),
gap_pick AS (SELECT profile, target_pct, arg_min(fund, (-alpha_3y, fund)) AS new_fund, arg_min(alpha_n, (-alpha_3y, fund)) AS new_alpha FROM gap_cand g WHERE NOT EXISTS (SELECT 1 FROM swapped s WHERE s.profile = g.profile AND s.target_pct = g.target_pct AND s.preference IS NULL AND s.fund = g.fund) GROUP BY 1, 2),
state AS (SELECT *, bool_or(role = 'outlier') OVER k AS has_outlier, role = 'core' AND row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY (role = 'core') DESC, coalesce(alpha_n, 0), pos) = 1 AS weakest FROM swapped WINDOW k AS (PARTITION BY profile, target_pct, preference)),
picked AS (SELECT s.*, coalesce(p.new_fund IS NOT NULL AND s.preference IS NULL AND NOT has_outlier, false) AS swaps, new_fund, new_alpha FROM state s LEFT JOIN gap_pick p ON p.profile = s.profile AND p.target_pct = s.target_pct AND s.preference IS NULL),
moved AS (SELECT profile, target_pct, preference, pos, swaps, CASE WHEN swaps AND weakest THEN new_fund ELSE fund END AS fund, CASE WHEN swaps AND weakest THEN 'gap' ELSE role END AS role, pct AS old, CASE WHEN swaps AND weakest THEN new_alpha ELSE alpha_n END AS alpha_n FROM picked),
sums AS (SELECT *, coalesce(sum(greatest(old - 15, 0)) FILTER (WHERE role = 'gap') OVER k, 0) AS freed, coalesce(sum(old) FILTER (WHERE role = 'core') OVER k, 0) AS core_sum, count(*) FILTER (WHERE role = 'core') OVER k AS cores FROM moved WINDOW k AS (PARTITION BY profile, target_pct, preference)),
shared AS (SELECT *, CASE WHEN role = 'gap' THEN least(old, 15) WHEN swaps AND role = 'core' AND freed > 0 THEN round(old + CASE WHEN core_sum > 0 THEN freed * old / core_sum ELSE freed / cores END, 1) ELSE old END AS p1 FROM sums),
rest AS (SELECT *, CASE WHEN swaps AND row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY p1 DESC, pos) = 1 THEN round(p1 + round(100 - sum(p1) OVER (PARTITION BY profile, target_pct, preference), 1), 1) ELSE p1 END AS p2 FROM shared),
over_v AS (SELECT r.*, CASE WHEN swaps AND role IN ('core', 'gap') THEN greatest(p2 - cap, 0) ELSE 0 END AS over_cap FROM rest r JOIN profile_v USING (profile)),
kind_gap AS (SELECT profile, target_pct, preference, pos, fund, role, CASE WHEN over_cap > 0 THEN round(p2 - over_cap, 1) WHEN swaps AND pos = 3 THEN round(p2 + sum(over_cap) OVER (PARTITION BY profile, target_pct, preference), 1) ELSE p2 END AS pct, alpha_n FROM over_v)"""


@query(GAP + OF_CLIENTS.format("kind_gap"))
def gap_swap(spark, sf_dir):
    """Clients without a preference have declared a gap; all their funds are candidates."""
    scored = _scored_with_facts(spark, sf_dir)
    swapped = V.settled(_swapped(spark, sf_dir, scored))
    gaps = swapped.where("preference IS NULL").select("client_id")
    cand = scored.select("client_id", F.col("fund_id").cast("string").alias("fund"), "alpha_n", "alpha_3y")
    return _of_clients(spark, sf_dir, portfolio.gap_swap(swapped, portfolio.gap_pick(cand, swapped, gaps), gaps))


@query(BASE + """, edited AS (SELECT profile, target_pct, preference, pos, CASE WHEN target_pct = 3 AND pos = 2 THEN (SELECT max(b.fund) FROM kind_base b WHERE b.profile = k.profile AND b.target_pct = k.target_pct AND b.preference IS NOT DISTINCT FROM k.preference AND b.pos = 1) WHEN target_pct = 4 AND pos = 1 THEN 'NONE' ELSE fund END AS fund,
  CASE WHEN target_pct = 5 AND pos = 1 THEN pct + 40 WHEN target_pct = 6 AND pos = 3 THEN NULL WHEN target_pct = 9 AND pos = 1 THEN 50.04 ELSE pct END AS pct FROM kind_base k WHERE NOT (target_pct = 7 AND pos = 4)),
bad AS (SELECT DISTINCT profile, target_pct, preference FROM edited WHERE pct IS NULL),
good AS (SELECT e.*, coalesce(b.role, 'core') AS role FROM edited e LEFT JOIN (SELECT DISTINCT profile, target_pct, preference, fund, role FROM kind_base) b ON b.profile = e.profile AND b.target_pct = e.target_pct AND b.preference IS NOT DISTINCT FROM e.preference AND b.fund = e.fund
         WHERE NOT EXISTS (SELECT 1 FROM bad x WHERE x.profile = e.profile AND x.target_pct = e.target_pct AND x.preference IS NOT DISTINCT FROM e.preference)
         UNION ALL SELECT k.profile, k.target_pct, k.preference, pos, fund, pct, role FROM kind_base k JOIN bad x ON x.profile = k.profile AND x.target_pct = k.target_pct AND x.preference IS NOT DISTINCT FROM k.preference),
h AS (SELECT client_id, g.*, cap, ceiling FROM client_v c JOIN good g ON c.profile = g.profile AND c.target_pct = g.target_pct AND c.preference IS NOT DISTINCT FROM g.preference JOIN profile_v v ON v.profile = c.profile),
facts AS (SELECT fund_id::VARCHAR AS fund, risk_level FROM fund_v UNION ALL VALUES ('GOLD', 5), ('CASH-C', 1)),
by_c AS (SELECT client_id, round(sum(pct::DECIMAL(18,4))::DOUBLE, 2) AS total, count(*) AS n, count(DISTINCT fund) AS funds, count(*) FILTER (WHERE role = 'structural:gold') > 0 AND count(*) FILTER (WHERE role = 'structural:money_market') > 0 AS sleeves FROM h GROUP BY 1)
SELECT client_id::VARCHAR AS subject, 'malformed_edit' AS code FROM client_v c JOIN edited e ON c.profile = e.profile AND c.target_pct = e.target_pct AND c.preference IS NOT DISTINCT FROM e.preference WHERE e.pct IS NULL
UNION ALL SELECT client_id::VARCHAR, 'sum' FROM by_c WHERE abs(total - 100) > 0.5 UNION ALL SELECT client_id::VARCHAR, 'count' FROM by_c WHERE n <> 4 UNION ALL SELECT client_id::VARCHAR, 'duplicate_holding' FROM by_c WHERE funds < n UNION ALL SELECT client_id::VARCHAR, 'structural' FROM by_c WHERE NOT sleeves
UNION ALL SELECT client_id::VARCHAR, 'concentration_cap' FROM h WHERE pct > cap UNION ALL SELECT client_id::VARCHAR, 'rl_ceiling' FROM h JOIN facts USING (fund) WHERE role NOT IN ('outlier', 'structural:gold', 'structural:money_market') AND risk_level > ceiling
UNION ALL SELECT client_id::VARCHAR, 'universe' FROM h LEFT JOIN facts USING (fund) WHERE risk_level IS NULL""")
def invariant_violations(spark, sf_dir):
    """Base portfolios after edits by people: by target, one holds a fund twice, one a fund that nobody knows, one too much, one a little over a cap, one lacks a share (so the edit doesn't count), one lacks a sleeve. The screened money market isn't in the universe."""
    clients = _kinds(spark, sf_dir).select("client_id", "kind", "profile", "target_pct")
    book = V.settled(_book(spark, sf_dir).select(F.col("client_id").alias("kind"), "pos", "fund", "role", "pct", "alpha_n"))
    held = clients.join(book, "kind").drop("kind")
    case = lambda target, pos: (F.col("target_pct") == target) & (F.col("pos") == pos)
    first = F.max(F.when(F.col("pos") == 1, F.col("fund"))).over(W.partitionBy("client_id"))
    edits = held.withColumn("first", first).where(~case(7, 4)).select("client_id", "pos", F.when(case(3, 2), F.col("first")).when(case(4, 1), "NONE").otherwise(F.col("fund")).alias("fund"), F.when(case(5, 1), F.col("pct") + 40).when(case(6, 3), F.lit(None)).when(case(9, 1), 50.04).otherwise(F.col("pct")).alias("pct"))
    new, bad = portfolio.edited(held, edits)
    new = new.join(clients.select("client_id", "profile"), "client_id")
    rows = new.select(F.col("client_id").alias("portfolio_id"), "fund", "role", "pct", scoring.profile_value(F.col("profile"), 3).alias("cap"), scoring.profile_value(F.col("profile"), 2).cast("int").alias("ceiling"))
    facts = V.funds(spark, sf_dir).select(F.col("fund_id").cast("string").alias("fund"), F.col("risk_level").cast("int").alias("risk_level"))
    rows = V.settled(rows)  # each rule reads them
    facts = facts.unionByName(spark.createDataFrame([("GOLD", 5), ("CASH-C", 1)], "fund string, risk_level int"))
    return checks.all_of(checks.portfolio_violations(rows, facts), checks.malformed_edits(bad)).select("subject", "code")


SLICES = {"low": ["s1", "s2"], "middle": ["s3"], "high": ["s4"], "top": ["s5"]}


@query(""", amounts AS (SELECT portfolio_id, sum((CASE WHEN risk_level <= 2 THEN weight ELSE 0 END)::DECIMAL(28,8))::DOUBLE AS low, sum((CASE WHEN risk_level = 3 THEN weight ELSE 0 END)::DECIMAL(28,8))::DOUBLE AS middle, sum((CASE WHEN risk_level = 4 THEN weight ELSE 0 END)::DECIMAL(28,8))::DOUBLE AS high, sum((CASE WHEN risk_level = 5 THEN weight ELSE 0 END)::DECIMAL(28,8))::DOUBLE AS top FROM holding_v JOIN fund_v USING (fund_id) GROUP BY 1),
long AS (SELECT portfolio_id, 0 AS pos, 'low' AS slice, low AS amount FROM amounts UNION ALL SELECT portfolio_id, 1, 'middle', middle FROM amounts UNION ALL SELECT portfolio_id, 2, 'high', high FROM amounts UNION ALL SELECT portfolio_id, 3, 'top', top FROM amounts),
s AS (SELECT *, round(amount / sum(amount) OVER (PARTITION BY portfolio_id) * 100, 1) AS s FROM long), g AS (SELECT *, round(100 - sum(s) OVER (PARTITION BY portfolio_id), 1) AS gap, row_number() OVER (PARTITION BY portfolio_id ORDER BY s DESC, pos) AS n FROM s)
SELECT portfolio_id, pos, slice, CASE WHEN n = 1 THEN round(s + gap, 1) ELSE s END AS pct FROM g""")
def asset_exposure(spark, sf_dir):
    """Risk levels stand for asset classes: each fund is wholly in one of five columns."""
    funds = V.funds(spark, sf_dir).select("fund_id", *(F.when(F.col("risk_level") == i, 100.0).otherwise(0.0).alias(f"s{i}") for i in range(1, 6)))
    held = V.holdings(spark, sf_dir).withColumn("role", F.lit("core"))
    return exposure.asset_exposure(held, funds, SLICES, tasks=V.tasks_for(spark, sf_dir))


@query(""", sums AS (SELECT portfolio_id, place, sum((weight * share / 100)::DECIMAL(28,8))::DOUBLE AS amount FROM holding_v JOIN geo_v USING (fund_id) GROUP BY 1, 2),
merged AS (SELECT portfolio_id, CASE WHEN round(amount, 6) < 2 AND place <> 'CHINA' THEN 'Other' ELSE place END AS place, sum(amount::DECIMAL(28,8))::DOUBLE AS amount FROM sums GROUP BY 1, 2),
every AS (SELECT * FROM merged UNION ALL SELECT DISTINCT portfolio_id, 'Other', 0.0 FROM merged WHERE portfolio_id NOT IN (SELECT portfolio_id FROM merged WHERE place = 'Other')),
s AS (SELECT *, CASE WHEN sum(amount) OVER (PARTITION BY portfolio_id) > 0 THEN round(amount / sum(amount) OVER (PARTITION BY portfolio_id) * 100, 1) ELSE 0 END AS s FROM every), g AS (SELECT *, round(100 - sum(s) OVER (PARTITION BY portfolio_id), 1) AS gap, row_number() OVER (PARTITION BY portfolio_id ORDER BY s DESC, place) AS n FROM s)
SELECT portfolio_id, place, CASE WHEN n = 1 THEN round(s + gap, 1) ELSE s END AS pct, row_number() OVER (PARTITION BY portfolio_id ORDER BY CASE place WHEN 'CHINA' THEN 0 WHEN 'Other' THEN 2 ELSE 1 END, CASE WHEN n = 1 THEN round(s + gap, 1) ELSE s END DESC, place)::INTEGER AS pos FROM g""")
def place_exposure(spark, sf_dir):
    return exposure.place_exposure(V.holdings(spark, sf_dir), V.places(spark, sf_dir), home="CHINA", tasks=V.tasks_for(spark, sf_dir)).select("portfolio_id", "place", "pct", "pos")


@query("""SELECT portfolio_id, round(sum((coalesce(weighted_alpha, 0) * weight)::DECIMAL(28,8))::DOUBLE / sum(weight::DECIMAL(28,8))::DOUBLE, 2) AS composite, round(sum((coalesce(alpha_3y, 0) * weight)::DECIMAL(28,8))::DOUBLE / sum(weight::DECIMAL(28,8))::DOUBLE, 2) AS alpha_3y,
round(sum((coalesce(risk_level, 3) * weight)::DECIMAL(28,8))::DOUBLE / sum(weight::DECIMAL(28,8))::DOUBLE, 2) AS risk_level, count(*) AS holdings FROM holding_v LEFT JOIN screened_v USING (fund_id) LEFT JOIN wide_v USING (fund_id) GROUP BY 1""")
def portfolio_averages(spark, sf_dir):
    facts = V.screened(spark, sf_dir).join(V.wide_alphas(spark, sf_dir).select("fund_id", "alpha_3y"), "fund_id").select("fund_id", F.col("weighted_alpha").alias("composite"), "alpha_3y", "risk_level")
    return exposure.portfolio_averages(V.holdings(spark, sf_dir), facts)


@query("SELECT portfolio_id, concat_ws(', ', CASE WHEN l > 0 THEN l || ' Low' END, CASE WHEN m > 0 THEN m || ' Moderate' END, CASE WHEN h > 0 THEN h || ' High' END) AS composition FROM (SELECT portfolio_id, count(*) FILTER (WHERE risk_level <= 2) AS l, count(*) FILTER (WHERE risk_level = 3) AS m, count(*) FILTER (WHERE risk_level > 3) AS h FROM holding_v LEFT JOIN fund_v USING (fund_id) GROUP BY 1)")
def composition(spark, sf_dir):
    label = S.band_up_to(F.col("risk_level").cast("double"), [(2.0, "Low"), (3.0, "Moderate"), (None, "High")])
    rows = V.holdings(spark, sf_dir).join(V.funds(spark, sf_dir).select("fund_id", "risk_level"), "fund_id", "left").select("portfolio_id", label.alias("label"))
    return exposure.composition(rows, ["Low", "Moderate", "High"])


@query("SELECT portfolio_id, fund_id, round(weight * 10, 2) AS amount FROM holding_v UNION ALL SELECT portfolio_id, 0, round(sum(round(weight * 10, 2)::DECIMAL(18,2))::DOUBLE, 2) FROM holding_v GROUP BY 1")
def contributions(spark, sf_dir):
    rows = exposure.contributions(V.holdings(spark, sf_dir))
    return rows.where("portfolio_id IS NOT NULL").withColumn("fund_id", F.coalesce("fund_id", F.lit(0)))


@query("SELECT fund_id, " + ", ".join(f"round(coalesce(sum(share) FILTER (WHERE place = '{n}'), 0), 1) AS \"{n}\"" for n in ("CHINA", "JAPAN", "INDIA")) + ", round(coalesce(sum(share) FILTER (WHERE place NOT IN ('CHINA', 'JAPAN', 'INDIA')), 0), 1) AS \"Other\" FROM (SELECT fund_id, place, share::DECIMAL(18,4) AS share FROM geo_v) GROUP BY 1".replace("round(coalesce(sum(share) FILTER", "round(coalesce(sum(share) FILTER"))
def bucket_pivot(spark, sf_dir):
    names = ["CHINA", "JAPAN", "INDIA"]
    entries = V.places(spark, sf_dir).withColumn("share", F.col("share").cast("decimal(18,4)"))
    return screening.bucket_pivot(entries, "fund_id", "place", "share", {n: n for n in names}, names)


@query("""SELECT p_partkey AS fund_id, CASE WHEN v <= 4.245 THEN 'Very Low' WHEN v <= 7.795 THEN 'Low' WHEN v <= 10.235 THEN 'Moderate' WHEN v <= 13.595 THEN 'High' ELSE 'Very High' END AS volatility,
least(greatest(CASE WHEN d >= -5 THEN 80.0 WHEN d >= -10 THEN 70 WHEN d >= -15 THEN 60 WHEN d >= -25 THEN 40 WHEN d >= -40 THEN 20 ELSE 10 END + CASE WHEN days < 30 THEN 15 WHEN days <= 90 THEN 10 WHEN days <= 180 THEN 5 WHEN days <= 365 THEN 0 ELSE -10 END, 0), 100)::DOUBLE AS momentum,
CASE WHEN e >= 60 THEN 'Equity-equivalent' WHEN 100 - e >= 60 THEN 'Defensive' ELSE 'Balanced' END AS derived, upper(replace(p_brand, ' ', '')) AS key, CASE WHEN contains(upper(p_type), 'STEEL') OR contains(upper(p_type), 'BRASS') THEN 'Metal' WHEN contains(upper(p_type), 'SMALL') THEN 'Small' ELSE 'Other' END AS kind
FROM (SELECT *, p_size / 3.0::DOUBLE AS v, -(p_size::DOUBLE) AS d, (p_partkey % 400)::INT AS days, (p_size * 2)::DOUBLE AS e FROM part)""")
def band_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") / 3.0).alias("v"), (-F.col("p_size").cast("double")).alias("d"), (F.col("p_partkey") % 400).cast("int").alias("days"), (F.col("p_size") * 2).cast("double").alias("e"))
    zero = F.lit(0.0)
    return rows.select(F.col("p_partkey").alias("fund_id"), S.band_up_to(F.col("v")).alias("volatility"), S.momentum(F.col("d"), F.col("days")).alias("momentum"), S.derived_class(F.col("e"), 100 - F.col("e"), zero, zero).alias("derived"), S.key_form(F.col("p_brand")).alias("key"), S.first_rule(F.col("p_type"), ((("STEEL", "BRASS"), "Metal"), (("SMALL",), "Small")), "Other").alias("kind"))


@query("""SELECT series, path, key FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY key DESC, path) AS n FROM (SELECT 'S' || o_custkey AS series, '/in/' || o_orderkey || '/[MFR ' || strftime(o_orderdate, '%b') || strftime(o_orderdate, '%y') || '] S' || o_custkey || '.pdf' AS path,
((year(o_orderdate) % 100) * 100 + month(o_orderdate))::INTEGER AS key FROM orders WHERE o_orderkey % 50 <> 0)) WHERE n = 1""")
def latest_per_series(spark, sf_dir):
    """Orders as monthly reports of their customers' series; those of some orders are of a kind that is left out."""
    month = F.date_format("o_orderdate", "MMM")
    path = F.concat(F.lit("/in/"), F.when(F.col("o_orderkey") % 50 == 0, "PRS").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("/[MFR "), month, F.date_format("o_orderdate", "yy"), F.lit("] S"), F.col("o_custkey").cast("string"), F.lit(".pdf"))
    return tables.latest_per_series(table(spark, sf_dir, "orders").select(path.alias("path")), without="/PRS")


@query("SELECT s_suppkey, n.n_regionkey::BIGINT AS region FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE lower(n_name) || ' ' END AS code, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s LEFT JOIN nation n ON upper(replace(s.code, ' ', '')) = upper(replace(n.n_name, ' ', ''))")
def keyed_lookup_fallback(spark, sf_dir):
    """Every second code is written in another way, so only its normal form is found."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(" "))).alias("code"))
    lookup = nation.select(F.col("n_name").alias("code"), F.col("n_regionkey").cast("bigint").alias("region"))
    return tables.with_fallback(rows, lookup, "code", "region", S.key_form).select("s_suppkey", "region")


@query("""SELECT source, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS rejects FROM (SELECT event_type AS source, len(string_split(line, '|')) = 3 AND try_cast(string_split(line, '|')[2] AS DOUBLE) IS NOT NULL AS good FROM (SELECT event_type, concat_ws('|', event_id::VARCHAR, CASE WHEN user_id % 10 = 0 THEN 'n/a' ELSE round(value, 2)::VARCHAR END, CASE WHEN user_id % 7 = 0 THEN 'a|b' ELSE 'a' END) AS line FROM events)) GROUP BY 1""")
def parse_with_rejects(spark, sf_dir):
    """Events written as delimited lines, some with a word for a number or a field too many, read back into good rows and rejects."""
    rows = table(spark, sf_dir, "events")
    value = F.when(F.col("user_id") % 10 == 0, "n/a").otherwise(S.half_up("value", 2).cast("string"))
    lines = rows.select(F.concat_ws("|", F.col("event_id").cast("string"), value, F.when(F.col("user_id") % 7 == 0, "a|b").otherwise("a")).alias("value"), F.col("event_id").alias("own"), F.col("event_type").alias("source"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("note", T.StringType())])
    good, bad = tables.delimited(lines.select("value"), schema)
    ids = good.select(F.col("event_id").alias("own"), F.lit(True).alias("good")).unionByName(bad.select(F.substring_index("line", "|", 1).cast("long").alias("own"), F.lit(False).alias("good")))
    return lines.select("own", "source").join(ids, "own").groupBy("source").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("rejects"))


@query("SELECT host, page_id, url FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, page_id, url, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1 AND host <> ''")
def first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), "page_id", "url")
    return master.first_seen(rows, "host", "page_id")


@query("""SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY part, pos)::INTEGER AS pos, kind, text FROM (SELECT o_custkey AS portfolio_id, 0 AS part, o_orderkey AS pos, 'sheet' AS kind, o_orderkey::VARCHAR AS text FROM orders
UNION ALL SELECT user_id, 1, event_id, 'link', event_type || ' ' || event_type || ' (' || strftime(ts, '%Y-%m-%d') || ')' FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id % 11 <> 0) WHERE n = 1)""")
def source_list(spark, sf_dir):
    """Orders as holdings of their customers, events as what was read for them; some have no address."""
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("portfolio_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("code"))
    url = F.when(F.col("event_id") % 11 != 0, F.col("event_type")).otherwise("")
    read = table(spark, sf_dir, "events").select(F.col("user_id").alias("portfolio_id"), F.col("event_id").alias("pos"), url.alias("source_url"), F.col("event_type").alias("theme"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return master.source_list(held, read)


RETAIL = """named AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'PB ' || p_name WHEN p_partkey % 31 = 0 THEN NULL ELSE p_name END AS name, 'F' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '-B' ELSE '-A' END AS code FROM part),
retail AS (SELECT * FROM named WHERE name IS NOT NULL AND name NOT LIKE 'PB %' AND code NOT LIKE '%-B' AND code NOT IN (SELECT code FROM named JOIN part USING (p_partkey) WHERE p_size = 1))"""


def _named(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 9 == 0, F.concat(F.lit("PB "), F.col("p_name"))).when(key % 31 == 0, F.lit(None)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"), F.concat(F.lit("F"), key.cast("string"), F.when(key % 5 == 0, "-B").otherwise("-A")).alias("code"))


def _retail(spark, sf_dir):
    funds = _named(spark, sf_dir)
    return master.retail_only(funds, funds.where("p_size = 1").select("code"))


@query("WITH " + RETAIL + " SELECT code, name FROM retail")
def retail_funds(spark, sf_dir):
    return _retail(spark, sf_dir).select("code", "name")


@query("WITH " + RETAIL + " SELECT code FROM retail UNION SELECT 'F' || l_partkey || '-A' FROM lineitem WHERE l_partkey IS NOT NULL")
def fund_universe(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("F"), F.col("l_partkey").cast("string"), F.lit("-A")).alias("code"))
    return master.fund_universe(_retail(spark, sf_dir), held)


@query("""WITH wanted AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) WHEN s_suppkey % 7 = 0 THEN n_name || '?' ELSE n_name END AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
codes AS (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey <> 4) SELECT w.n_name AS code, coalesce(a.n_regionkey, b.n_regionkey)::INTEGER AS region, CASE WHEN a.n_name IS NOT NULL THEN 'exact' WHEN b.n_name IS NOT NULL THEN 'form' ELSE 'missing' END AS found
FROM wanted w LEFT JOIN codes a ON a.n_name = w.n_name LEFT JOIN codes b ON upper(replace(b.n_name, ' ', '')) = upper(replace(w.n_name, ' ', ''))""")
def resolved_codes(spark, sf_dir):
    """Names of suppliers' nations, some in small letters and some that no map has; the map lacks a nation. Missing ones are those that neither way finds."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    wanted = rows.select(F.when(F.col("s_suppkey") % 3 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 7 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("code"))
    codes = nation.where("n_nationkey <> 4").select(F.col("n_name").alias("code"), F.col("n_regionkey").alias("region"))
    found, unmatched = master.resolved_codes(wanted, codes, "code", "region", S.key_form)
    lost = master.missing_keys(wanted, found, "code").join(unmatched, "code", "left_semi")
    return found.select("code", "region", F.when(F.col("exact"), "exact").otherwise("form").alias("found")).unionByName(lost.select("code", F.lit(None).cast("int").alias("region"), F.lit("missing").alias("found")))


@query("""WITH top AS (SELECT max(p_partkey) AS m FROM part) SELECT p_partkey AS row, 'F' || p_partkey AS code, coalesce(p_name, '') AS name, p_partkey % 3 = 0 AS screened, CASE WHEN p_partkey % 4 <> 0 THEN p_size END::INTEGER AS risk_level, p_retailprice AS weighted_alpha,
p_size::DOUBLE AS alpha_3y, NULL::DOUBLE AS fund_5y, (p_size % 10)::DOUBLE AS dom, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS holdings, (p_partkey % 400)::INTEGER AS days FROM part, top WHERE p_partkey <= floor(0.9 * m)""")
def master_reader(spark, sf_dir):
    """Parts written as cells of text, of which the last tenth follows a row without a code; numbers that are words are null."""
    part = table(spark, sf_dir, "part")
    end = F.broadcast(part.agg(F.floor(F.max("p_partkey") * 0.9).alias("m")))
    text = lambda c: c.cast("string")
    cells = part.join(end, F.lit(True)).select(
        F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") == F.col("m") + 1, " ").otherwise(F.concat(F.lit(" F"), text(F.col("p_partkey")))).alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, " Shariah").otherwise("Conventional").alias("series"),
        F.when(F.col("p_partkey") % 4 != 0, text(F.col("p_size"))).otherwise("n/a").alias("risk_level"), text(F.col("p_retailprice")).alias("weighted_alpha"), text(F.col("p_size")).alias("3y_alpha"), F.lit("-").alias("5y_fund"), text(F.col("p_size") % 10).alias("dom"), F.regexp_replace("p_type", " ", " | ").alias("top_holdings"), text(F.col("p_partkey") % 400).alias("days_from_ath"),
    )
    rows = master.master_rows(cells, assets=["dom"])
    return rows.select("row", "code", "name", "screened", "risk_level", "weighted_alpha", F.col("returns")["3y"]["alpha"].alias("alpha_3y"), F.col("returns")["5y"]["fund"].alias("fund_5y"), F.col("assets")["dom"].alias("dom"), F.size("top_holdings").cast("bigint").alias("holdings"), F.col("days_from_ath").alias("days"))


SECTORS = ["Industrial", "Technology", "Telecommunications", "Internet", "Consumer, Cyclical", "Electric", "REITS", "ETF", "Weird"]


@query(""", sect AS (SELECT fund_id, CASE p % 9 WHEN 0 THEN 'Industrial' WHEN 1 THEN 'Technology' WHEN 2 THEN 'Communications' WHEN 3 THEN 'Communications' WHEN 4 THEN 'Consumer Discretionary' WHEN 5 THEN 'Energy' WHEN 6 THEN 'Real Estate' ELSE 'Other Sector' END AS bucket, share FROM (SELECT fund_id, n_nationkey AS p, share FROM geo_v JOIN nation ON n_name = place)),
sector_v AS (SELECT fund_id, round(sum(share::DECIMAL(18,4)) FILTER (WHERE bucket = 'Energy'), 1) AS energy, round(sum(share::DECIMAL(18,4)) FILTER (WHERE bucket = 'Communications'), 1) AS communications, round(sum(share::DECIMAL(18,4)) FILTER (WHERE bucket = 'Other Sector'), 1) AS other_sector FROM sect GROUP BY 1),
country_v AS (SELECT fund_id, round(max(share) FILTER (WHERE place = 'CHINA'), 1) AS china, round(max(share) FILTER (WHERE place = 'JAPAN'), 1) AS japan, round(nullif(sum(share::DECIMAL(18,4)) FILTER (WHERE place NOT IN ('CHINA', 'FRANCE', 'GERMANY', 'INDONESIA', 'JAPAN')), 0)::DOUBLE, 1) AS geo_other FROM geo_v GROUP BY 1),
high_v AS (SELECT fund_id, max(nav) AS top, arg_max(nav, nav_date) AS last FROM nav_v GROUP BY 1)
SELECT f.fund_id, CASE WHEN s.qualified THEN 'Qualified' ELSE 'Disqualified' END AS status, coalesce(out_periods, 0) || '/' || coalesce(s.total_periods, 0) AS periods, s.weighted_alpha, CASE WHEN f.screened THEN 'Shariah' ELSE 'Conventional' END AS series, alpha_3y, ret_5y, round(alpha_1y / (f.risk_level * 2.0::DOUBLE), 2) AS efficiency_1y,
coalesce(energy, 0)::DOUBLE AS energy, coalesce(communications, 0)::DOUBLE AS communications, coalesce(other_sector, 0)::DOUBLE AS other_sector, china, japan, geo_other, CASE WHEN top > 0 THEN round((last - top) / top * 100, 2) END AS drawdown_pct,
p_type || ' | ' || p_brand AS top_holdings, top_sectors, f.risk_level * 2.0::DOUBLE AS volatility, CASE WHEN f.risk_level * 2 <= 4.245 THEN 'Very Low' WHEN f.risk_level * 2 <= 7.795 THEN 'Low' WHEN f.risk_level * 2 <= 10.235 THEN 'Moderate' ELSE 'High' END AS volatility_class, p_type AS peer_group, p_brand AS benchmark, '[MFR JAN24] ' || f.name || '.txt' AS source_file
FROM fund_v f JOIN part ON p_partkey = f.fund_id LEFT JOIN (SELECT fund_id, string_agg(place || ' (' || printf('%.1f', round(share, 1)) || '%)', ' | ' ORDER BY share DESC, place) AS top_sectors FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY share DESC, place) AS n FROM geo_v) WHERE n <= 5 GROUP BY 1) t USING (fund_id)
LEFT JOIN screened_v s USING (fund_id) LEFT JOIN wide_v w USING (fund_id) LEFT JOIN sector_v USING (fund_id) LEFT JOIN country_v USING (fund_id) LEFT JOIN high_v USING (fund_id)""")
def wide_master(spark, sf_dir):
    """The master table of all funds; sales by nation stand for shares by place and, with the nations' numbers, by sector."""
    return _wide_shown(master.wide_rows(**_wide_parts(spark, sf_dir)))


def _wide_parts(spark, sf_dir, once=lambda rows: rows):
    """What wide_rows() puts together; once is done to what several parts read."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fund_id"), F.col("p_type").alias("peer_group"), F.col("p_brand").alias("benchmark"))
    funds = V.funds(spark, sf_dir).select("fund_id", "name", F.col("fund_id").cast("string").alias("code"), "screened", F.lit("").alias("category"), F.col("class").alias("asset_class"), F.lit("Global").alias("geography"), F.lit("Income").alias("objective"), "risk_level", F.lit("Annual").alias("policy"), (F.col("risk_level") * F.lit(2.0)).alias("volatility"))
    places, alphas = once(V.places(spark, sf_dir)), once(V.alphas(spark, sf_dir))
    keys = table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), F.col("n_nationkey").alias("p"))
    sector = F.get(F.array(*map(F.lit, SECTORS)), F.col("p") % len(SECTORS))
    sectors = master.sector_buckets(places.join(keys, "place").select("fund_id", sector.alias("sector"), F.concat(F.col("share").cast("decimal(18,4)").cast("string"), F.lit("%")).alias("weight")))
    countries = master.country_buckets(places.withColumn("place", F.initcap("place")))
    highs = nav.drawdown(nav.all_time_high(V.prices(spark, sf_dir)), F.lit(AS_OF).cast("date"))
    source = F.concat(F.lit("[MFR JAN24] "), "name", F.lit(".txt")).alias("source_file")
    funds = funds.join(part, "fund_id").join(master.top_texts(places, "fund_id", "place", "share", "top_sectors"), "fund_id", "left").select("*", F.array("peer_group", "benchmark").alias("top_holdings"), source)
    return {"funds": funds, "screened": V.screened(spark, sf_dir, alphas), "alphas": alphas, "places": countries, "sectors": sectors, "highs": highs}


def _wide_shown(rows):
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
    figures = ["fund_id", "status", "periods", "weighted_alpha", "series", F.col("3y_alpha").alias("alpha_3y"), F.col("5y_fund").alias("ret_5y"), "efficiency_1y", zero("Sector: Energy").alias("energy"), zero("Sector: Communications").alias("communications"), zero("Sector: Other Sector").alias("other_sector"), F.col("`Geo: China`").alias("china"), F.col("`Geo: Japan`").alias("japan"), F.col("`Geo: Geo Other`").alias("geo_other"), "drawdown_pct"]
    return rows.select(*figures, *master.DETAILS)


@query(SQL["wide_master"])
def wide_master_stored(spark, sf_dir):
    """The master table from tables that are stored in buckets by fund: no join of it shuffles. Each table is written by itself, so what several come from is written first."""
    return _wide_shown(master.wide_rows(**stored.co_partitioned(_wide_parts(spark, sf_dir, V.settled), "fund_id", V.scratch(spark))))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')) AS heading, \"left\"(nullif(trim(regexp_extract(html, '<p[^>]*>([^<]*)</p>', 1)), ''), 300) AS objective FROM pages")
def page_fields(spark, sf_dir):
    title, head, para = "<title>([^<]*)</title>", "<h1[^>]*>([^<]*)</h1>", "<p[^>]*>([^<]*)</p>"
    return extraction.fields(table(spark, sf_dir, "pages"), "page_id", "html", {"title": [title], "heading": [head, title], "objective": [para]}, {"objective": 300})


@query("""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, min(pos) FILTER (WHERE regexp_matches(line, '[.]$')) OVER (PARTITION BY doc_id) AS s FROM l), e AS (SELECT *, min(pos) FILTER (WHERE pos > s AND regexp_matches(line, 'License')) OVER (PARTITION BY doc_id) AS e FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM e WHERE pos > s AND (e IS NULL OR pos < e) AND length(trim(line)) >= 4 AND NOT regexp_matches(line, '^[0-9.,%[:space:]]+$'))
SELECT doc_id, rank::INTEGER AS rank, md5(line) AS line_md5 FROM k WHERE rank <= 5""")
def line_section_top5(spark, sf_dir):
    """The first five lines of the section between a line that ends with a stop and one that names a licence."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kept = extraction.section(lines, "doc_id", r"\.$", ["License"])
    return extraction.first_lines(kept, "doc_id").select("doc_id", "rank", F.md5("line").alias("line_md5"))


@query("SELECT conv_id, block::INTEGER AS block, count(*) AS turns, min(turn) AS first_turn FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations) WHERE block > 0 GROUP BY 1, 2")
def turn_blocks(spark, sf_dir):
    rows = extraction.blocks(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))


@query("SELECT fund_id, y AS year, fund_ret FROM (SELECT l_partkey AS fund_id, year(l_shipdate)::INTEGER AS y, round(sum(l_discount::DECIMAL(28,6))::DOUBLE / count(l_discount), 6) AS fund_ret FROM lineitem GROUP BY 1, 2)")
def calendar_returns(spark, sf_dir):
    """Yearly returns packed into lists and matched again by position."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fund_id"), F.year("l_shipdate").alias("y")).agg(V.mean(F.col("l_discount")).alias("r"))
    packed = rows.groupBy("fund_id").agg(F.sort_array(F.collect_list(F.struct("y", "r"))).alias("z"))
    lists = packed.select("fund_id", F.transform("z", lambda e: e["y"].cast("string")).alias("years"), F.transform("z", lambda e: e["r"].cast("string")).alias("f"), F.transform("z", lambda e: e["r"].cast("string")).alias("b"))
    return extraction.calendar_returns(lists, "fund_id", "years", "f", "b").select("fund_id", "year", "fund_ret")


@query("""SELECT page_id::VARCHAR AS subject, 'section_count' AS code FROM pages WHERE len(regexp_extract_all(html, '<(h[1-3])')) <> 1 UNION ALL SELECT page_id::VARCHAR, 'section_order' FROM pages WHERE len(regexp_extract_all(html, '<(h[1-3])')) = 1 AND regexp_extract(html, '<(h[1-3])', 1) <> 'h1'
UNION ALL SELECT page_id::VARCHAR, 'disclosure_missing' FROM pages WHERE NOT (contains(html, '<title>') AND contains(html, '</p>')) UNION ALL SELECT page_id::VARCHAR, 'disclosure_order' FROM pages WHERE contains(html, '<title>') AND contains(html, '</p>') AND position('<title>' IN html) >= position('</p>' IN html)
UNION ALL SELECT page_id::VARCHAR, 'unfilled_slot' FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'nav|footer')) AS slot FROM pages)""")
def doc_violations(spark, sf_dir):
    """Rules of documents on web pages: one top heading, a title before the first paragraph's end, and leftovers of layout."""
    pages = table(spark, sf_dir, "pages")
    found = checks.all_of(
        checks.section_violations(pages, "<(h[1-3])", ["h1"], "page_id"),
        checks.required_text(pages, ["<title>", "</p>"], "{{", "1", "version=([0-9]+)", "page_id").where("code LIKE 'disclosure%'"),
        checks.unfilled(pages, ["nav", "footer"], "page_id"),
    )
    return found.select("subject", "code")


@query(NORMAL + """, shown AS (SELECT portfolio_id || '/' || fund_id AS key, pct, CASE WHEN fund_id % 50 = 0 THEN pct + 1 ELSE pct END AS other, fund_id % 97 = 0 AS gone FROM normal)
SELECT key AS subject, 'render_missing' AS code FROM shown WHERE gone UNION ALL SELECT key, 'render_pct' FROM shown WHERE NOT gone AND abs(pct - other) > 0.05""")
def render_reconcile(spark, sf_dir):
    """Allocations against a rendered copy in which some are changed and some are missing."""
    rows = normalise_residual(spark, sf_dir)
    state = rows.select(F.concat_ws("/", "portfolio_id", "fund_id").alias("key"), "pct", "fund_id")
    shown = state.where("fund_id % 97 <> 0").select("key", F.when(F.col("fund_id") % 50 == 0, F.col("pct") + 1).otherwise(F.col("pct")).alias("pct"))
    return checks.reconciled(state.select("key", "pct"), shown, "key", {"pct": 0.05}).select("subject", "code")


@query("SELECT p_partkey::VARCHAR AS subject, 'label_kind' AS code FROM part WHERE split_part(p_type, ' ', 1) NOT IN ('SMALL', 'LARGE', 'ECONOMY') UNION ALL SELECT p_partkey::VARCHAR, 'label_metal' FROM part WHERE string_split(p_type, ' ')[-1] NOT IN ('STEEL', 'BRASS')")
def snapshot_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.element_at(F.split("p_type", " "), -1).alias("metal"))
    return checks.labels_outside(rows, "p_partkey", {"kind": ["SMALL", "LARGE", "ECONOMY"], "metal": ["STEEL", "BRASS"]}).select("subject", "code")


@query("SELECT fund_id, ath_date::VARCHAR AS ath_date, datediff('day', ath_date, DATE '2024-01-31')::INTEGER AS days_from_ath FROM (SELECT v.fund_id, min(nav_date) AS ath_date FROM nav_v v JOIN (SELECT fund_id, max(nav) AS top FROM nav_v GROUP BY 1) m ON v.fund_id = m.fund_id AND v.nav = m.top GROUP BY 1) WHERE datediff('day', ath_date, DATE '2024-01-31') <= 10")
def recent_highs(spark, sf_dir):
    state = nav.drawdown(nav.all_time_high(V.prices(spark, sf_dir)), F.lit("2024-01-31").cast("date"))
    return nav.recent_highs(state, 10).select("fund_id", F.col("ath_date").cast("string").alias("ath_date"), "days_from_ath")


@query("SELECT fund_id::VARCHAR AS subject, 'drawdown_positive' AS code FROM (SELECT fund_id, max(nav) AS top, arg_max(nav, nav_date) AS last FROM nav_v GROUP BY 1) WHERE fund_id % 4 = 0 AND top > 0 AND round((last - top) / top * 100, 2) < 0 UNION ALL SELECT fund_id::VARCHAR, 'no_high' FROM fund_v WHERE fund_id NOT IN (SELECT fund_id FROM nav_v)")
def high_sanity(spark, sf_dir):
    """Drawdowns of every fourth fund with the wrong sign, and funds without any price."""
    state = nav.drawdown(nav.all_time_high(V.prices(spark, sf_dir)), F.lit(AS_OF).cast("date"))
    state = state.withColumn("drawdown_pct", F.when(F.col("fund_id") % 4 == 0, -F.col("drawdown_pct")).otherwise(F.col("drawdown_pct")))
    return checks.snapshot_sanity(V.funds(spark, sf_dir), state).select("subject", "code")


NAMES = ["Alpha Equity China Fund", "Beta Money Market", "Gamma Sukuk", "Delta Balanced Global", "Epsilon Income", "Zeta Flexi Asia Pacific", "Eta Bond", "Theta Equity Malaysia Index"]
PEERS = ["Equity Global", "Bond MYR", "Mixed Asset MYR", "Equity Malaysia", "", "Sukuk", "Equity Asia Pacific"]
CATEGORIES = ["Equity", "Fund of Funds (Equity)", "Sukuk", "Balanced Equity", "Wholesale (money)", "", "Wholesale", "Money Market"]
POLICIES = ["No distribution", "Semi-annual", "Monthly", "Annual", "Incidental", "?"]
AIMS = ["capital growth with dividends", "steady income", "capital growth", "liquidity", "price of gold", "", "growth and income"]
DATES = ["2024-01-05", "Q2 2026", "2024-11-30", "soon"]
HAS = lambda c, *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("WITH t AS (SELECT p_partkey AS k, " + ", ".join(f"({xs!r})[p_partkey % {len(xs)} + 1] AS {n}" for n, xs in (("nm", NAMES), ("pg", PEERS), ("cat", CATEGORIES), ("pol", POLICIES), ("aim", AIMS), ("dt", DATES))) + " FROM part), u AS (SELECT *, upper(nm) AS n, upper(pg) AS c, lower(aim) AS a, lower(pg) AS p, lower(cat) AS l FROM t), "
    f"v AS (SELECT *, CASE WHEN {HAS('l', 'fund of funds', 'fund-of-funds')} THEN 'Fund of Funds' WHEN {HAS('l', 'money market')} THEN 'Money Market' WHEN {HAS('l', 'bond', 'sukuk', 'fixed income')} THEN 'Fixed Income' WHEN {HAS('l', 'mixed asset', 'balanced')} THEN 'Mixed Asset / Balanced' WHEN {HAS('l', 'equity')} THEN 'Equity' WHEN {HAS('l', 'wholesale')} AND {HAS('l', 'money')} THEN 'Money Market' ELSE '' END AS fund_type, "
    f"CASE WHEN {HAS('n', 'MONEY MARKET', 'CASH DEPOSIT', 'CASH MANAGEMENT')} THEN 'Money Market' WHEN {HAS('n', 'SUKUK')} OR {HAS('c', 'SUKUK')} THEN 'Bond / Sukuk' WHEN {HAS('n', 'BALANCED')} THEN 'Balanced' WHEN {HAS('c', 'MIXED ASSET')} OR {HAS('n', 'MIXED', 'ALLOCATION', 'FLEXI')} THEN 'Mixed Asset' WHEN {HAS('n', 'BOND', 'FIXED INCOME')} OR ({HAS('n', 'INCOME')} AND ({HAS('c', 'BOND')} OR NOT {HAS('c', 'EQUITY')})) THEN 'Bond / Fixed Income' "
    f"WHEN ({HAS('n', 'EQUITY')} OR {HAS('c', 'EQUITY')}) AND ({HAS('c', 'MALAYSIA')} OR {HAS('n', 'MALAYSIA', 'DOMESTIC')}) THEN 'Equity - Malaysia' WHEN {HAS('n', 'EQUITY')} OR {HAS('c', 'EQUITY')} THEN 'Equity - Foreign' WHEN {HAS('c', 'BOND', 'FIXED')} THEN 'Bond / Fixed Income' ELSE 'Other' END AS asset_class, "
    f"CASE WHEN {HAS('n', 'MALAYSIA')} THEN 'Malaysia' WHEN {HAS('n', 'CHINA')} THEN 'Greater China' WHEN {HAS('n', 'ASIA PACIFIC')} THEN 'Asia Pacific' WHEN {HAS('n', 'GLOBAL')} THEN 'Global' ELSE 'Malaysia' END AS place, "
    f"CASE WHEN (({HAS('a', 'capital growth')}) AND ({HAS('a', 'income', 'dividend', 'yield')})) OR {HAS('a', 'growth and income')} THEN 'Capital Growth + Income' WHEN {HAS('a', 'income', 'dividend', 'yield')} THEN 'Income' WHEN {HAS('a', 'capital growth')} THEN 'Capital Growth' WHEN {HAS('a', 'liquidity')} THEN 'Income' WHEN {HAS('a', 'gold', 'price of')} THEN 'Capital Growth' ELSE '' END AS objective, "
    f"p <> '' AND NOT {HAS('p', 'malaysia', 'myr', 'domestic')} AND {HAS('p', 'asia', 'global')} AS is_foreign, CASE pol WHEN 'Semi-annual' THEN 'Semi-Annual' WHEN 'Monthly' THEN pol WHEN 'Annual' THEN pol WHEN 'Incidental' THEN pol ELSE 'None' END AS policy FROM u) "
    "SELECT k AS fund_id, fund_type, CASE WHEN fund_type <> '' THEN fund_type WHEN asset_class IN ('Bond / Sukuk', 'Bond / Fixed Income') THEN 'Fixed Income' WHEN asset_class IN ('Mixed Asset', 'Balanced') THEN 'Mixed Asset / Balanced' WHEN asset_class = 'Money Market' THEN 'Money Market' ELSE 'Equity' END AS type_or, asset_class, place, objective, is_foreign, policy, "
    "k % 6 = 0 OR contains(nm, 'Sukuk') AS series, CASE WHEN k % 10 = 0 THEN 'structural:gold' ELSE 'core' END AS role, CASE WHEN k % 10 = 0 THEN 'gold' WHEN k % 3 = 0 THEN 'bond' WHEN k % 3 = 1 THEN 'equity' WHEN fund_type = 'Fixed Income' THEN 'bond' ELSE 'equity' END AS held_as, "
    "CASE WHEN regexp_matches(dt, '^[0-9]{4}-') THEN strftime(try_cast(dt AS DATE), '%d %b %Y') ELSE dt END AS event_day, asset_class = 'Other' OR objective = '' OR fund_type = '' OR (place = 'Malaysia' AND is_foreign) AS unsure, CASE WHEN k % 5 = 0 THEN '' ELSE printf('%.2f', k / 4.0::DOUBLE) END AS shown, 'X ' || k AS clean, k % 2 = 0 AS truthy, 'FundProposal_' || k || '_' || 'VeryHigh_2024-01-05_v1' AS file FROM v")
def classify_funds(spark, sf_dir):
    """Names, peer groups, categories, policies and objectives dealt to parts by their number, and all that is told from such texts."""
    k = F.col("k")
    of = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", of(NAMES).alias("nm"), of(PEERS).alias("pg"), of(CATEGORIES).alias("cat"), of(POLICIES).alias("pol"), of(AIMS).alias("aim"), of(DATES).alias("dt"))
    kind, asset, place, aim = S.fund_type(F.col("cat")), S.asset_class(F.col("nm"), F.col("pg")), S.place_of(F.col("nm")), S.objective_class(F.col("aim"))
    foreign, role = S.foreign_region(F.col("pg"), S.HOME_MARKS, S.FOREIGN_MARKS), S.structural_role(F.when(k % 10 == 0, "G").otherwise("x"), {"G": "structural:gold"})
    derived = F.when(k % 3 == 0, "Defensive").when(k % 3 == 1, "Equity-equivalent")
    code = F.concat(F.when(k % 6 == 0, "QI").otherwise("P"), k.cast("string"))
    return t.select(
        k.alias("fund_id"), kind.alias("fund_type"), S.fund_type_or(kind, asset).alias("type_or"), asset.alias("asset_class"), place.alias("place"), aim.alias("objective"), foreign.alias("is_foreign"), S.distribution(F.col("pol")).alias("policy"),
        S.series_flag(F.when(F.contains("nm", F.lit("Sukuk")), "x Shariah.pdf").otherwise("x.pdf"), F.col("nm"), code, prefixes=["QI"]).alias("series"), role.alias("role"), S.holding_label(role, derived, kind).alias("held_as"), S.event_date(F.col("dt")).alias("event_day"),
        checks.low_confidence(asset, aim, kind, foreign, place, S.HOME).alias("unsure"), S.shown(F.when(k % 5 != 0, k / 4.0)).alias("shown"), S.clean_name(F.concat(F.lit("X  "), k.cast("string"), F.lit(" (new)\x07")), ["(new)"]).alias("clean"), S.truthy(F.when(k % 2 == 0, " Yes ").otherwise("no")).alias("truthy"),
        S.output_name(S.person_name(k.cast("string")), F.lit("Very High"), F.lit("2024-01-05").cast("date"), F.lit("1")).alias("file"),
    )


@query("""WITH w AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line, string_split(unnest(a), ' ') AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))
SELECT doc_id::VARCHAR AS doc, line * 12.0::DOUBLE AS y, md5(array_to_string(list_slice(ws, 6, len(ws)), ' ')) AS line_md5 FROM w WHERE len(ws) >= 6""")
def boxes_to_lines(spark, sf_dir):
    """Words of documents as boxes, ten apart and a little off their lines; those right of the page's middle become lines again."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), "text").repartition(V.tasks_for(spark, sf_dir, "documents", 2_000), "doc")  # texts move, not their words
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
    words = lines.select("doc", "line", F.posexplode(F.split("x", " ", -1)).alias("i", "text"))
    boxes = words.select("doc", F.lit(1).alias("page"), (F.col("i") * 10 + 60).cast("double").alias("x0"), (F.col("line") * 12 + F.col("i") % 3 * 0.5).cast("double").alias("top"), "text")
    return extraction.boxes_to_lines(boxes, 200.0).select("doc", "y", F.md5("text").alias("line_md5"))


@query("SELECT fund_id::VARCHAR AS doc, label, pct FROM (SELECT fund_id, place || CASE WHEN fund_id % 2 = 0 THEN ' shares - Domestic' ELSE ' shares' END AS label, round(share, 1) AS pct FROM geo_v)")
def allocation_from_boxes(spark, sf_dir):
    """Shares by place as a table of word boxes between its heading and its total: label and percent on one line, its second part on the line below; words right of the table are another's."""
    rows = V.places(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("fund_id").orderBy("place")))
    word = lambda x, top, text: F.struct(F.lit(float(x)).alias("x0"), top.cast("double").alias("top"), text.alias("text"))
    at = F.col("n") * 24
    body = rows.select(F.col("fund_id").cast("string").alias("doc"), F.inline(F.array(word(20, at, F.col("place")), word(150, at, F.lit("shares")), word(220, at, F.format_string("%.1f%%", S.half_up("share", 1))), word(400, at, F.lit("Other text 5.0%")), word(20, at + 12, F.when(F.col("fund_id") % 2 == 0, "- Domestic").otherwise(" ")))))
    ends = rows.groupBy(F.col("fund_id").cast("string").alias("doc")).agg(F.max("n").alias("n")).select("doc", F.inline(F.array(word(20, F.lit(4), F.lit("Asset")), word(60, F.lit(5), F.lit("Allocation")), word(20, at + 40, F.lit("Total")), word(220, at + 41, F.lit("100.0%")), word(20, at + 60, F.lit("Below 9.0%")))))
    return extraction.allocation_from_boxes(body.unionByName(ends).withColumn("page", F.lit(1)), tasks=V.tasks_for(spark, sf_dir, each=60_000)).select("doc", "label", "pct")


@query("""SELECT portfolio_id, rank, name FROM (SELECT o_custkey AS portfolio_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS rank, 'Holding ' || o_orderkey AS name FROM orders) WHERE rank <= 5""")
def holdings_lines(spark, sf_dir):
    """A customer's orders as names below a heading, the first on the heading's own line, numbers between them."""
    nth = F.row_number().over(W.partitionBy("portfolio_id").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("portfolio_id"), "o_orderkey").withColumn("nth", nth)
    name = F.concat(F.lit("Holding "), F.col("o_orderkey").cast("string"))
    first = F.col("nth") == 1
    lines = rows.select("portfolio_id", F.inline(F.array(F.struct((F.col("nth") * 2).alias("pos"), F.when(first, F.concat(F.lit("No. Security Name "), name)).otherwise(name).alias("line")), F.struct((F.col("nth") * 2 + 1).alias("pos"), F.lit("12.5 %").alias("line")))))
    early = rows.where(first).select("portfolio_id", F.lit(0).alias("pos"), F.lit("Some text before").alias("line"))
    return extraction.holdings_lines(lines.unionByName(early), "portfolio_id")


@query("SELECT fund_id, period, round(fund_ret, 2) AS fund_ret, round(bench_ret, 2) AS bench_ret FROM alpha_v WHERE period IN ('ytd', '1y', '3y')")
def period_fields(spark, sf_dir):
    """Returns written as reports write them, two numbers for the year to date and four for longer periods, and read again."""
    num = lambda c: F.format_string("%.2f", S.half_up(c, 2))
    label = {"ytd": "Year to date", "1y": "1-year", "3y": "3-year"}
    text = F.concat_ws(" ", *(F.when(F.col(f"ret_{p}").isNotNull(), F.concat_ws(" ", F.lit(x), *([] if p == "ytd" else [F.lit("9.00 8.00")]), num(f"ret_{p}"), num(f"b_{p}"))) for p, x in label.items()), F.lit("end"))
    wide = V.alphas(spark, sf_dir).groupBy("fund_id").agg(*(F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{n}_{p}") for p in label for c, n in (("fund_ret", "ret"), ("bench_ret", "b"))))
    return extraction.period_returns(wide.select("fund_id", text.alias("text")), "fund_id", "text", label).select("fund_id", "period", "fund_ret", "bench_ret")


CARD_DOCS = """WITH card AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS part, 'F' || l_partkey || CASE WHEN l_partkey % 20 = 0 THEN '-B' ELSE '' END AS code, (l_partkey % 60 + 30)::DOUBLE AS score, l_partkey % 17 = 0 AS off, l_partkey % 19 = 0 AS short, l_partkey % 23 = 0 AS alpha_off, l_partkey % 29 = 0 AS strange, l_partkey % 4 = 0 AS out, l_partkey % 12 = 0 AS silent, l_partkey % 37 = 0 AS summary_off FROM lineitem)"""


@query(CARD_DOCS + """ SELECT doc::VARCHAR AS subject, 'composite' AS code FROM card WHERE off AND NOT short UNION ALL SELECT doc::VARCHAR, 'malformed_bar' FROM card WHERE short UNION ALL SELECT doc::VARCHAR, 'alpha' FROM card WHERE alpha_off UNION ALL SELECT doc::VARCHAR, 'unknown_fund' FROM card WHERE strange
UNION ALL SELECT doc::VARCHAR, 'warning' FROM card WHERE NOT strange AND out AND silent UNION ALL SELECT doc::VARCHAR, 'retail_eligibility' FROM card WHERE NOT strange AND part % 20 = 0 UNION ALL SELECT doc::VARCHAR, 'summary' FROM card WHERE summary_off UNION ALL SELECT DISTINCT doc::VARCHAR, 'exposure_sum' FROM card WHERE doc % 41 = 0""")
def card_checks(spark, sf_dir):
    """Orders as proposals with a card for each line: scores, bars, a row of returns, a warning, a summary and a legend, some of them wrong, which the checks read from the text."""
    k = F.col("l_partkey")
    card = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey").repartition(V.tasks_for(spark, sf_dir), "doc")
    card = card.withColumns({"code": F.concat(F.when(k % 29 == 0, "Z").otherwise("F"), k.cast("string"), F.when(k % 20 == 0, "-B").otherwise("")), "s": (k % 60 + 30).cast("double")})  # lines move, not their texts
    num = lambda c: F.format_string("%.2f", c)
    shown = F.col("s") + F.when(k % 17 == 0, 5.0).otherwise(0.0)
    bars = F.array_join(F.array_repeat(F.concat(num(F.col("s")), F.lit(" / 100 at 25.0% weight")), F.when(k % 19 == 0, 3).otherwise(4)), ";")
    row = F.concat(F.lit(" [3.50 1.25 "), F.when(k % 23 == 0, "3.25").otherwise("2.25"), F.lit("] "))
    warn = F.when((k % 4 == 0) & (k % 12 != 0), "ALPHA WARNING").otherwise("")
    text = F.concat(F.lit("<card>Name \u00b7 "), F.col("code"), F.lit(" \u2014 core\nscore "), num(shown), F.lit("|"), bars, row, warn, F.lit(" sum "), num(shown + F.when(k % 37 == 0, 2.0).otherwise(0.0)), F.lit(";"))
    docs = card.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("x")))), lambda c: c["x"]), "").alias("cards"))
    html = F.concat(F.lit("top {legend 60.0% "), F.when(F.col("doc") % 41 == 0, "30.0%").otherwise("40.0%"), F.lit("}"), F.col("cards"))
    docs = docs.select(F.col("doc").alias("doc_id"), html.alias("html"))
    facts = table(spark, sf_dir, "part").where("p_partkey % 29 <> 0").select(F.concat(F.lit("F"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 20 == 0, "-B").otherwise("")).alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 == 0, "Disqualified").otherwise("Qualified").alias("status"))
    cards = checks.cards(docs, "<card>")
    legend = docs.select("doc_id", F.lit("legend").alias("block"), F.explode(F.regexp_extract_all(F.regexp_extract("html", r"\{legend ([^}]*)\}", 1), F.lit(r"([0-9.]+)%"), F.lit(1))).alias("pct"))
    return checks.all_of(
        checks.card_violations(cards, facts, r"score ([0-9.]+)\|", r"([0-9.]+) / 100 at ([0-9.]+)% weight", r"\[([0-9.-]+) ([0-9.-]+) ([0-9.-]+)\]", "ALPHA WARNING", r" sum ([0-9.]+);"),
        checks.sums_off(legend.withColumn("pct", F.col("pct").cast("double")), "doc_id", "block", "pct"),
    ).select("subject", "code")
