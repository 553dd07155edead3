"""The model's tables, as views of general business tables: parts as funds, discounts as returns, events as prices, customers as clients, orders as portfolios."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.config import PERIODS
from quayside.functions.scalars import half_up
from quayside.operators.measures import blend, efficiency, efficiency_pick, penalised, period_alpha
from quayside.operators.screening import screen

YEARS = {2001: "ytd", 2000: "1y", 1999: "3y", 1998: "5y", 1997: "10y"}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; where that is unset a temporary one if Spark runs in this process alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quayside-')}"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(rows: DataFrame) -> DataFrame:
    """A result that several parts of a plan read, computed once: a table in a folder that driver and executors share."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tasks_for(spark: SparkSession, sf_dir: str, name: str = "lineitem", each: int = 300_000) -> int:
    """So many tasks that each gets about `each` rows of a table, but no fewer than shuffle partitions: a task's memory then doesn't grow with the table. The count comes from the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // each))


def mean(c: Column, digits: int = 6) -> Column:
    """A mean that doesn't depend on the order of rows: summed as decimals."""
    return half_up(F.sum(c.cast("decimal(28,6)")).cast("double") / F.nullif(F.count(c), F.lit(0)), digits)


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("fund_id"), F.col("p_name").alias("name"), F.col("p_type").alias("class"), (F.col("p_size") % 5 + 1).alias("risk_level"), (F.expr("CAST(substring(p_brand, 7) AS INT)") % 2 == 0).alias("screened"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each fund with sales in those years: ret_<period>, null where there are none. Sales are shuffled once, as sums of tasks by fund."""
    year = F.year("l_shipdate")
    line = table(spark, sf_dir, "lineitem").where(year.between(min(YEARS), max(YEARS))).select(F.col("l_partkey").alias("fund_id"), year.alias("y"), "l_discount")
    return line.groupBy("fund_id").agg(*((mean(F.when(F.col("y") == y, F.col("l_discount"))) * 100).alias(f"ret_{p}") for y, p in YEARS.items()))


def _long(rows: DataFrame, keep: list[str], values: dict[str, str]) -> DataFrame:
    """A row for each period of a wide row that has a return; partitioning by fund stays as it was."""
    periods = F.array(*(F.struct(F.lit(p).alias("period"), *(F.col(f"{prefix}_{p}").alias(c) for c, prefix in values.items())) for p in YEARS.values()))
    return rows.select(*keep, F.inline(F.filter(periods, lambda e: e[next(iter(values))].isNotNull())))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_yearly(spark, sf_dir), ["fund_id"], {"fund_ret": "ret"})


def _with_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fund_id, class, ret_<period> and bench_<period>, the mean of the fund's class.

    The means are a few rows, summed where the returns lie and joined back; no class is gathered in one task. Both sides read the same sums by fund, so their shuffle is used twice.
    """
    rows = _yearly(spark, sf_dir).join(funds(spark, sf_dir).select("fund_id", "class"), "fund_id")
    of = lambda p: half_up(F.sum(F.col(f"ret_{p}").cast("decimal(18,6)")).cast("double") / F.nullif(F.count(f"ret_{p}"), F.lit(0)), 6)
    return rows.join(rows.groupBy("class").agg(*(of(p).alias(f"bench_{p}") for p in YEARS.values())), "class")


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns against the mean of their class: fund_id, class, period, fund_ret, bench_ret, alpha, beat."""
    return period_alpha(_long(_with_bench(spark, sf_dir), ["fund_id", "class"], {"fund_ret": "ret", "bench_ret": "bench"}))


def wide_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fund_id, class, ret_<period> and alpha_<period>."""
    rows = _with_bench(spark, sf_dir)
    return rows.select("fund_id", "class", *(F.col(f"ret_{p}") for p in PERIODS), *(half_up(F.col(f"ret_{p}") - F.col(f"bench_{p}"), 2).alias(f"alpha_{p}") for p in PERIODS))


def screened(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The screen's result with each fund's facts; of: alphas(), where they are there already."""
    facts = funds(spark, sf_dir).select("fund_id", "name", F.col("class").alias("fund_type"), "screened", "risk_level")
    return screen(alphas(spark, sf_dir) if of is None else of).join(facts, "fund_id")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funds with what scoring needs: alpha (penalised blend), blended return, efficiency, momentum."""
    wide = wide_alphas(spark, sf_dir)
    by = lambda n: {p: F.col(f"{n}_{p}") for p in PERIODS}
    rows = wide.select("fund_id", penalised(blend(by("alpha")), F.col("alpha_3y"), F.col("alpha_5y")).alias("alpha"), (blend(by("ret"))).alias("blended"), "alpha_3y", "alpha_5y", "alpha_1y")
    rows = rows.join(funds(spark, sf_dir), "fund_id")
    vol = F.col("risk_level").cast("double") * 2
    return rows.select("*", efficiency_pick(efficiency(F.col("alpha_3y"), vol), efficiency(F.col("alpha_1y"), vol)).alias("efficiency"), (F.col("fund_id") % 101).cast("double").alias("momentum"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price for each fund and day: the day's last event."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("fund_id"), F.to_date("ts").alias("nav_date"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("nav"))
    return rows.groupBy("fund_id", "nav_date").agg(F.max_by("nav", "at").alias("nav"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    profile = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Conservative' WHEN 'BUILDING' THEN 'Aggressive' WHEN 'FURNITURE' THEN 'Moderately Aggressive' ELSE 'Moderate' END")
    wish = F.expr("CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END")
    return rows.select(F.col("c_custkey").alias("client_id"), profile.alias("profile"), (3 + F.col("c_custkey") % 8).cast("double").alias("target_pct"), wish.alias("preference"))


def holdings(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """portfolio_id, fund_id, amount (decimal) and weight, its share in percent. Lines move to their portfolio once, in as many tasks as there are lines for; what goes by portfolio after that has no shuffle.

    facts: columns by fund_id (a row for each) that lines take along, null where a fund has none.
    """
    took = [c for c in facts.columns if c != "fund_id"] if facts is not None else []
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("portfolio_id"), F.col("l_partkey").alias("fund_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    line = line.join(facts, "fund_id", "left") if took else line
    rows = line.repartition(tasks_for(spark, sf_dir), "portfolio_id").groupBy("portfolio_id", "fund_id").agg(F.sum("price").alias("amount"), *(F.first(c).alias(c) for c in took))
    total = F.sum("amount").over(W.partitionBy("portfolio_id")).cast("double")
    return rows.withColumn("weight", half_up(F.col("amount").cast("double") / total * 100, 4))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fund_id, place and share in percent: where a part's sales come from. Suppliers and nations are small next to sales; Spark broadcasts them by size. Sales move to their part once, in as many tasks as there are lines for."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = line.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("fund_id"), F.col("n_name").alias("place"), "price")
    rows = rows.repartition(tasks_for(spark, sf_dir), "fund_id").groupBy("fund_id", "place").agg(F.sum("price").alias("amount"))
    total = F.sum("amount").over(W.partitionBy("fund_id")).cast("double")
    return rows.select("fund_id", "place", half_up(F.col("amount").cast("double") / total * 100, 4).alias("share"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customer nations that buy most from each supplier, as its top holdings."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    buyer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sums = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("fund_id"), F.col("c_nationkey").alias("item")).agg(F.sum("price").alias("amount"))
    nth = F.row_number().over(W.partitionBy("fund_id").orderBy(F.desc("amount"), "item"))
    return sums.withColumn("nth", nth).where("nth <= 5").select("fund_id", "item", "nth")


#: The same views for DuckDB.
VIEWS = """
WITH fund_v AS (SELECT p_partkey AS fund_id, p_name AS name, p_type AS class, p_size % 5 + 1 AS risk_level, CAST(substring(p_brand, 7) AS INT) % 2 = 0 AS screened FROM part),
returns_v AS (SELECT l_partkey AS fund_id, CASE year(l_shipdate) WHEN 2001 THEN 'ytd' WHEN 2000 THEN '1y' WHEN 1999 THEN '3y' WHEN 1998 THEN '5y' WHEN 1997 THEN '10y' END AS period,
              round(sum(l_discount::DECIMAL(28,6))::DOUBLE / count(l_discount), 6) * 100 AS fund_ret FROM lineitem WHERE year(l_shipdate) BETWEEN 1997 AND 2001 GROUP BY 1, 2),
bench_v AS (SELECT class, period, round(sum(fund_ret::DECIMAL(28,6))::DOUBLE / count(*), 6) AS bench_ret FROM returns_v JOIN fund_v USING (fund_id) GROUP BY 1, 2),
alpha_v AS (SELECT r.fund_id, class, period, fund_ret, bench_ret, round(fund_ret - bench_ret, 2) + 0.0 AS alpha, fund_ret > bench_ret AS beat FROM returns_v r JOIN fund_v USING (fund_id) JOIN bench_v USING (class, period)),
weight_v(period, w) AS (VALUES ('ytd', 5.0::DOUBLE), ('1y', 15.0), ('3y', 40.0), ('5y', 25.0), ('10y', 15.0)),
screen_v AS (SELECT fund_id, CASE WHEN count(*) >= 2 THEN round(sum((w * alpha)::DECIMAL(28,6))::DOUBLE / sum(w::DECIMAL(18,4))::DOUBLE, 4) END AS weighted_alpha, count(*) AS total_periods,
             count(*) FILTER (WHERE beat) AS out_periods, round(count(*) FILTER (WHERE beat) / count(*) * 100, 1) AS rate FROM alpha_v JOIN weight_v USING (period) GROUP BY 1),
screened_v AS (SELECT s.*, coalesce(weighted_alpha > 0, false) AS qualified, name, class AS fund_type, screened, risk_level FROM screen_v s JOIN fund_v USING (fund_id)),
wide_v AS (SELECT fund_id, class, """ + ", ".join(f"max(fund_ret) FILTER (WHERE period = '{p}') AS ret_{p}, max(alpha) FILTER (WHERE period = '{p}') AS alpha_{p}" for p in PERIODS) + """ FROM alpha_v GROUP BY 1, 2),
blend_v AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {n}_3y IS NULL AND {n}_5y IS NULL AND {n}_1y IS NULL AND {n}_ytd IS NULL THEN 0 ELSE round((coalesce({n}_3y * 40, 0) + coalesce({n}_5y * 30, 0) + coalesce({n}_1y * 20, 0) + coalesce({n}_ytd * 10, 0)) / (CASE WHEN {n}_3y IS NULL THEN 0 ELSE 40 END + CASE WHEN {n}_5y IS NULL THEN 0 ELSE 30 END + CASE WHEN {n}_1y IS NULL THEN 0 ELSE 20 END + CASE WHEN {n}_ytd IS NULL THEN 0 ELSE 10 END), 4) + 0.0 END AS blend_{n}"
    for n in ("ret", "alpha")
) + """ FROM wide_v),
measured_v AS (SELECT fund_id, f.class, risk_level, screened, blend_alpha * CASE WHEN alpha_3y < 0 THEN 0.5 ELSE 1 END * CASE WHEN alpha_5y < 0 THEN 0.5 ELSE 1 END + 0.0 AS alpha, blend_ret AS blended, alpha_3y, alpha_5y, alpha_1y,
               coalesce(alpha_3y / (risk_level * 2.0::DOUBLE), alpha_1y / (risk_level * 2.0::DOUBLE), 0) AS efficiency, (fund_id % 101)::DOUBLE AS momentum FROM blend_v JOIN fund_v f USING (fund_id)),
nav_v AS (SELECT user_id AS fund_id, ts::DATE AS nav_date, arg_max(value, (ts, event_id)) AS nav FROM events GROUP BY 1, 2),
client_v AS (SELECT c_custkey AS client_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Conservative' WHEN 'BUILDING' THEN 'Aggressive' WHEN 'FURNITURE' THEN 'Moderately Aggressive' ELSE 'Moderate' END AS profile,
             (3 + c_custkey % 8)::DOUBLE AS target_pct, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS preference FROM customer),
profile_v(profile, mid, high, ceiling, cap, b_alpha, b_returnfit, b_efficiency, b_momentum) AS (VALUES ('Conservative', 3.5::DOUBLE, 4.0::DOUBLE, 2, 50.0::DOUBLE, 28.0::DOUBLE, 40.0::DOUBLE, 25.0::DOUBLE, 7.0::DOUBLE), ('Moderate', 5, 6, 3, 50, 28, 40, 20, 12),
          ('Moderately Aggressive', 7, 8, 4, 60, 26, 40, 17, 17), ('Aggressive', 9, 10, 5, 70, 30, 40, 13, 17)),
move_v AS (SELECT c.*, mid, high, ceiling, cap, CASE WHEN target_pct > mid THEN least(10.0, 10 * ((target_pct - mid) / mid)) ELSE -least(5.0, -5 * ((target_pct - mid) / mid)) END AS move, b_alpha, b_returnfit, b_efficiency, b_momentum FROM client_v c JOIN profile_v USING (profile)),
raw_v AS (SELECT *, least(greatest(b_alpha - move, 5), 50) AS r_a, least(greatest(b_returnfit + move, 5), 50) AS r_r, least(greatest(b_efficiency, 5), 50) AS r_e, least(greatest(b_momentum, 5), 50) AS r_m FROM move_v),
weighted_v AS (SELECT *, round(r_a / (r_a + r_r + r_e + r_m) * 100, 2) AS w_alpha, round(r_r / (r_a + r_r + r_e + r_m) * 100, 2) AS w_returnfit, round(r_e / (r_a + r_r + r_e + r_m) * 100, 2) AS w_efficiency, round(r_m / (r_a + r_r + r_e + r_m) * 100, 2) AS w_momentum FROM raw_v),
kind_v AS (SELECT DISTINCT profile, target_pct, preference, ceiling, w_alpha, w_returnfit, w_efficiency, w_momentum FROM weighted_v),
universe_v AS (SELECT k.ceiling, k.preference, m.* FROM (SELECT DISTINCT ceiling, preference FROM kind_v) k JOIN measured_v m ON m.risk_level <= k.ceiling AND (k.preference IS NULL OR k.preference = m.screened)),
member_v AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY ceiling, preference, class) = 1 THEN 100.0 ELSE round(100 * percent_rank() OVER (PARTITION BY ceiling, preference, class ORDER BY alpha), 1) END AS alpha_n,
             CASE WHEN count(*) OVER (PARTITION BY ceiling, preference, class) = 1 THEN 100.0 ELSE round(100 * percent_rank() OVER (PARTITION BY ceiling, preference, class ORDER BY efficiency), 1) END AS efficiency_n,
             max(blended) OVER (PARTITION BY ceiling, preference, class) < 0 AS all_negative FROM universe_v),
met_v AS (SELECT k.profile, k.target_pct, k.preference, fund_id, class, alpha_n, efficiency_n, momentum AS momentum_n, all_negative, blended / k.target_pct AS x, w_alpha, w_returnfit, w_efficiency, w_momentum FROM kind_v k JOIN member_v m ON k.ceiling = m.ceiling AND k.preference IS NOT DISTINCT FROM m.preference),
fit_v AS (SELECT *, CASE WHEN all_negative THEN 0.0 WHEN x <= 0 THEN 0.0 WHEN x < 0.25 THEN round(0 + (x - 0) / 0.25 * 5, 1) WHEN x < 0.5 THEN round(5 + (x - 0.25) / 0.25 * 15, 1) WHEN x < 0.75 THEN round(20 + (x - 0.5) / 0.25 * 30, 1) WHEN x < 1 THEN round(50 + (x - 0.75) / 0.25 * 30, 1) WHEN x < 1.5 THEN round(80 + (x - 1) / 0.5 * 20, 1) ELSE 100.0 END AS returnfit_n FROM met_v),
score_v AS (SELECT *, round((w_alpha * alpha_n + w_returnfit * returnfit_n + w_efficiency * efficiency_n + w_momentum * momentum_n) / 100, 2) AS composite FROM fit_v),
ranked_v AS (SELECT *, row_number() OVER (PARTITION BY profile, target_pct, preference ORDER BY composite DESC, alpha_n DESC, efficiency_n DESC, fund_id)::INTEGER AS position FROM score_v),
holding_v AS (SELECT portfolio_id, fund_id, amount, round(amount::DOUBLE / (sum(amount) OVER (PARTITION BY portfolio_id))::DOUBLE * 100, 4) AS weight FROM (SELECT l_orderkey AS portfolio_id, l_partkey AS fund_id, sum(l_extendedprice::DECIMAL(18,2)) AS amount FROM lineitem GROUP BY 1, 2)),
geo_v AS (SELECT fund_id, place, round(amount::DOUBLE / (sum(amount) OVER (PARTITION BY fund_id))::DOUBLE * 100, 4) AS share FROM (SELECT l_partkey AS fund_id, n_name AS place, sum(l_extendedprice::DECIMAL(18,2)) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)),
basket_v AS (SELECT fund_id, item, nth FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY amount DESC, item) AS nth FROM (SELECT l_suppkey AS fund_id, c_nationkey AS item, sum(l_extendedprice::DECIMAL(18,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE nth <= 5)
"""


def exact(sql: str) -> str:
    """round(x, n) of a DuckDB text with x as a decimal, as half_up() has it: both engines then round the same number."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, end = 1, -1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if depth == 1 and sql[end] == "," else comma
            end += 1
        inner = exact(sql[start + 6 : comma])
        out += [sql[at:start], f"round(({inner})::DECIMAL(28,10), {sql[comma + 1 : end - 1].strip()})::DOUBLE"]
        at = end
    return "".join(out) + sql[at:]
