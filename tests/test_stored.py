"""Tables in buckets of their key, and reports of which only those that are asked for are opened."""

import os

import pytest
from pyspark.sql import functions as F

from quayside.operators import master, measures, screening
from quayside.sources import stored


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    """Reports of three series; one of them and one of an old month can't be read, since they aren't what their names say."""
    at = str(tmp_path / "in")
    _write(at, "[MFR JAN24] A+B Fund.txt", "old\n")
    _write(f"{at}/deep", "[MFR FEB24] A+B Fund.txt", "new\nlines\n")
    _write(f"{at}/later", "[MFR FEB24] A+B Fund.txt", "again\n")
    _write(at, "[MFR XXX24] Odd.txt", "odd\n")
    _write(at, "[MFR MAR24] C.txt", "c\n")
    _write(at, "notes.txt", "no report\n")
    _write(at, "[MFR DEC19] C.txt.gz", "no gzip")
    return at


#: The pattern that takes compressed files for reports too.
ANY = r"\[MFR ([A-Za-z]{3})(\d{2})\] (.+)\.txt(?:\.gz)?$"


def test_reports(spark, folder):
    found = lambda **k: sorted((r.series, r.key, r.line) for r in stored.reports(spark, folder, **k).collect())
    every = [("A+B Fund", 2401, "old"), ("A+B Fund", 2402, "again"), ("A+B Fund", 2402, "lines"), ("A+B Fund", 2402, "new"), ("C", 2403, "c"), ("Odd", 2400, "odd")]
    assert found() == every
    assert found(series=["C", "Odd"]) == every[4:]
    assert found(since=2401, until=2402) == every[:4]
    assert found(series=["none"]) == []


def test_only_what_is_asked_for_is_opened(spark, folder):
    with pytest.raises(Exception, match="gz|GZIP|incorrect header"):
        stored.reports(spark, folder, pattern=ANY).collect()
    assert stored.reports(spark, folder, since=2000, pattern=ANY).count() == 6
    assert stored.reports(spark, folder, ["Odd"], pattern=ANY).count() == 1


def test_latest_reports(spark, folder):
    found = sorted((r.series, r.key, r.line) for r in stored.latest_reports(spark, folder, pattern=ANY).collect())  # the broken file is older than any series' newest
    assert found == [("A+B Fund", 2402, "lines"), ("A+B Fund", 2402, "new"), ("C", 2403, "c"), ("Odd", 2400, "odd")]
    assert stored.latest_reports(spark, folder, ["none"]).collect() == []
    assert [r.line for r in stored.latest_reports(spark, folder, ["C"]).collect()] == ["c"]


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def _parts(spark):
    funds = spark.range(200).select(
        F.col("id").alias("fund_id"), F.concat(F.lit("Fund "), "id").alias("name"), F.col("id").cast("string").alias("code"), (F.col("id") % 2 == 0).alias("screened"), F.lit("").alias("category"), F.lit("Equity").alias("asset_class"), F.lit("Global").alias("geography"),
        F.lit("Income").alias("objective"), F.lit(2).alias("risk_level"), F.lit("Annual").alias("policy"), (F.col("id") % 20).cast("double").alias("volatility"), F.array(F.lit("Bank"), F.lit("Rail")).alias("top_holdings"), F.lit("Asia").alias("peer_group"),
    )
    periods = funds.select("fund_id", F.explode(F.array(*map(F.lit, ("1y", "3y")))).alias("period"), (F.col("fund_id") % 7).cast("double").alias("fund_ret"), F.lit(3.0).alias("bench_ret"))
    alphas = measures.period_alpha(periods)
    places = funds.select("fund_id", F.lit("China").alias("place"), F.lit(40.0).alias("share"))
    return {"funds": funds, "screened": screening.screen(alphas), "alphas": alphas, "places": master.country_buckets(places)}


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parts = _parts(spark)
        plain = master.wide_rows(**parts)
        kept = stored.co_partitioned(parts, "fund_id", str(tmp_path / "stored"), 3)
        wide = master.wide_rows(**kept)
        assert _exchanges(plain) > 0 and _exchanges(wide) == 0
        assert wide.columns == plain.columns
        assert wide.exceptAll(plain).isEmpty() and plain.exceptAll(wide).isEmpty() and wide.count() == 200
        files = [f for f in os.listdir(tmp_path / "stored" / "funds") if f.endswith(".parquet")]
        assert len(files) == 3  # one for each bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_keys_and_empty_tables_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a"), (None, None)], "k int, v string")
    kept = stored.co_partitioned({"rows": rows, "none": rows.limit(0)}, "k", str(tmp_path / "s"), 2)
    assert kept["rows"].exceptAll(rows).isEmpty() and kept["rows"].count() == 4 and kept["none"].count() == 0


def test_details_of_wide_rows(spark):
    parts = _parts(spark)
    entries = spark.createDataFrame([(1, n, w) for n, w in (("b", 1.0), ("a", 1.0), ("x", 30.25), ("c", 0.5), ("d", 0.5), ("e", 0.1))] + [(2, None, 1.0)], "fund_id long, name string, pct double")
    parts["funds"] = parts["funds"].join(master.top_texts(entries, "fund_id", "name", "pct", "top_sectors"), "fund_id", "left")
    got = {r.fund_id: r for r in master.wide_rows(**parts).where("fund_id < 20").collect()}
    assert got[1].top_sectors == "x (30.3%) | a (1.0%) | b (1.0%) | c (0.5%) | d (0.5%)" and got[3].top_sectors is None
    assert (got[1].top_holdings, got[1].peer_group, got[1].benchmark) == ("Bank | Rail", "Asia", None)
    assert [got[i].volatility_class for i in (4, 5, 8, 13, 14)] == ["Very Low", "Low", "Moderate", "High", "Very High"]


def test_screen_is_one_aggregation(spark):
    rows = spark.createDataFrame([(1, "1y", 1.0, True), (1, "3y", -1.0, False), (2, "1y", None, None), (3, "7y", 5.0, True), (3, "1y", 2.0, True)], "fund_id int, period string, alpha double, beat boolean")
    got = {r.fund_id: r for r in screening.screen(rows).collect()}
    assert (got[1].total_periods, got[1].out_periods, got[1].rate) == (2, 1, 50.0)
    assert (got[2].weighted_alpha, got[2].total_periods, got[2].rate, got[2].qualified) == (None, 0, 0.0, False)
    assert (got[3].weighted_alpha, got[3].total_periods, got[3].out_periods, got[3].rate) == (None, 1, 2, 100.0)  # a period without a weight is beaten, but doesn't count for the score
    assert got[1].weighted_alpha == round((15 * 1.0 - 40 * 1.0) / 55, 4)
