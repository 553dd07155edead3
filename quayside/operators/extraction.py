"""Fields out of page text and word boxes: ordered lines, sections, blocks, numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.functions.scalars import number


def boxes_to_lines(boxes: DataFrame, width: float, from_share: float = 0.52, grid: float = 4.0) -> DataFrame:
    """doc, page, y, text: words (doc, page, x0, top, text) from a share of the width on, on lines of a grid (half to even), joined from left to right."""
    kept = boxes.where(F.col("x0") >= from_share * width).withColumn("y", F.bround(F.col("top") / grid) * grid)
    words = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    return kept.groupBy("doc", "page", "y").agg(F.array_join(words, " ").alias("text"))


def section(lines: DataFrame, key: str, start: str, stop: Sequence[str], pos: str = "pos", text: str = "line") -> DataFrame:
    """The lines after the first that matches start, up to the next one that matches a stop; without a stop, to the end.

    Windows are in the order of pos, as first_lines() has it, so both read one sort.
    """
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    opened = lines.withColumn("_s", F.min(F.when(F.col(text).rlike(start), F.col(pos))).over(w))
    closed = opened.withColumn("_e", F.min(F.when((F.col(pos) > F.col("_s")) & F.col(text).rlike("|".join(stop)), F.col(pos))).over(w))
    return closed.where((F.col(pos) > F.col("_s")) & (F.col("_e").isNull() | (F.col(pos) < F.col("_e")))).drop("_s", "_e")


def first_lines(lines: DataFrame, key: str, k: int = 5, least: int = 4, pos: str = "pos", text: str = "line") -> DataFrame:
    """The first k lines of each key that are long enough and more than a number, with rank."""
    good = lines.where((F.length(F.trim(text)) >= least) & ~F.col(text).rlike(r"^[\d.,%\s]+$"))
    return good.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(pos))).where(F.col("rank") <= k)


def named_percents(lines: DataFrame, key: str, pattern: str = r"^(.+?)\s+(\d+\.\d+)\s*%", allowed: DataFrame | None = None, pos: str = "pos", text: str = "line") -> DataFrame:
    """name and pct of lines such as 'Japan 12.5%'; with allowed (name) only those; the last of a name counts."""
    rows = lines.where(F.col(text).rlike(pattern)).select(key, pos, F.regexp_extract(text, pattern, 1).alias("name"), F.regexp_extract(text, pattern, 2).cast("double").alias("pct"))
    rows = rows if allowed is None else rows.join(allowed.select("name").distinct(), "name", "left_semi")
    return rows.groupBy(key, "name").agg(F.max_by("pct", pos).alias("pct"))


def blocks(pages: DataFrame, key: str, pos: str, header: Column) -> DataFrame:
    """Adds block, counted from 1 at each row whose header holds; rows before the first are dropped."""
    n = F.sum(F.when(header, 1).otherwise(0)).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("block", n.cast("int")).where("block > 0")


def period_returns(pages: DataFrame, key: str, text: str, labels: Mapping[str, str]) -> DataFrame:
    """key, period, fund_ret, bench_ret, total: of the numbers after a period's label, four give the last two (annualised), two give a total."""
    num = r"(-?\d+\.\d+)"
    out = []
    for period, label in labels.items():
        four, two = rf"{label}\s+{num}\s+{num}\s+{num}\s+{num}", rf"{label}\s+{num}\s+{num}"
        is_four = F.col(text).rlike(four)
        value = lambda i, j, four=four, two=two, is_four=is_four: F.when(is_four, number(F.regexp_extract(text, four, i))).otherwise(number(F.regexp_extract(text, two, j)))
        out.append(F.struct(F.lit(period).alias("period"), value(3, 1).alias("fund_ret"), value(4, 2).alias("bench_ret"), (~is_four).alias("total")))
    return pages.select(key, F.inline(F.array(*out))).where(F.col("fund_ret").isNotNull())


def year_to_date(returns: DataFrame, key: str) -> DataFrame:
    """The total of 'ytd' if there is one, else the plain return."""
    ytd = returns.where(F.col("period") == "ytd")
    return ytd.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("total"), F.col("fund_ret"))), F.max(F.when(~F.col("total"), F.col("fund_ret")))).alias("ytd"))


def calendar_returns(rows: DataFrame, key: str, years: str, fund: str, bench: str) -> DataFrame:
    """year, fund_ret, bench_ret of three lists matched by position, to the shortest; what isn't a number is passed over."""
    n = F.least(F.size(years), F.size(fund), F.size(bench))
    zipped = F.arrays_zip(F.slice(years, 1, n).alias("y"), F.slice(fund, 1, n).alias("f"), F.slice(bench, 1, n).alias("b"))
    flat = rows.where(n > 0).select(key, F.explode(zipped).alias("z"))
    return flat.select(key, F.col("z.y").try_cast("int").alias("year"), number(F.col("z.f")).alias("fund_ret"), number(F.col("z.b")).alias("bench_ret")).where("year IS NOT NULL AND fund_ret IS NOT NULL AND bench_ret IS NOT NULL")


def fields(pages: DataFrame, key: str, text: str, patterns: Mapping[str, Sequence[str]], longest: Mapping[str, int] | None = None) -> DataFrame:
    """One column per field: the first group of the first pattern that is found, cut to longest; else null."""
    first = lambda ps: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in ps))
    cut = lambda n, c: F.left(c, F.lit((longest or {})[n])) if n in (longest or {}) else c
    return pages.select(key, *(cut(n, first(ps)).alias(n) for n, ps in patterns.items()))


def without_noise(value: Column, phrases: Sequence[str]) -> Column:
    """value up to the first of some phrases that stands after its start."""
    out = value
    for p in phrases:
        out = F.when(F.locate(p, out) > 1, F.trim(F.substring_index(out, p, 1))).otherwise(out)
    return out


def allocation(lines: DataFrame, key: str, pos: str = "pos", text: str = "line", tails: Sequence[str] = ("securities", "Islamic", "- Domestic", "- Foreign"), header: str = "Asset Type") -> DataFrame:
    """label and pct of a table whose labels may run over several lines: parts add up until a percent comes, and following lines that begin with one of tails belong to the row above.

    Blank lines and the header are passed over; of a label that comes twice the last counts. Each percent closes a group of lines, so groups are
    counted backward; a line is a tail where the nearest line above that doesn't look like one has a percent.
    """
    w = W.partitionBy(key).orderBy(pos)
    line = F.trim(text)
    pct = F.nullif(F.regexp_extract(text, r"(\d+\.\d+)%", 1), F.lit("")).cast("double")
    rows = lines.where((line != "") & ~F.contains(line, F.lit(header))).withColumn("_pct", pct)
    tail_like = F.col("_pct").isNull() & reduce(lambda a, b: a | b, (line.startswith(t) for t in tails), F.lit(False))
    above = F.last(F.when(~tail_like, F.col("_pct").isNotNull()), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_tail", tail_like & F.coalesce(above, F.lit(False)))
    before = F.coalesce(F.sum(F.when(F.col("_pct").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_row", before - F.when(F.col("_tail"), 1).otherwise(0))
    part = F.trim(F.when(F.col("_pct").isNotNull(), F.regexp_extract(text, r"^(.*?)\d+\.\d+%", 1)).otherwise(F.col(text)))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), part.alias("t")))), lambda x: x["t"]), lambda t: t != "")
    grouped = rows.groupBy(key, "_row").agg(F.max("_pct").alias("pct"), F.array_join(parts, " ").alias("label"))
    named = grouped.where(F.col("pct").isNotNull() & (F.col("label") != ""))
    return named.groupBy(key, "label").agg(F.max_by("pct", "_row").alias("pct"))


def allocation_from_boxes(boxes: DataFrame, right: float = 310.0, reach: float = 120.0, grid: float = 4.0, tasks: int | None = None) -> DataFrame:
    """doc, page, label and pct of the table between its heading and its total on each page of word boxes (doc, page, x0, top, text).

    The heading is the first 'Asset' that has 'Allocation' beside it, the end the first 'Total' below with '100.0%' beside it, else reach below
    the heading; words left of right stand on lines of a grid (half to even), which allocation() reads. Words beside each other differ by less than 5 in top. Pages
    meet their anchors by windows over the page; a page without a heading gives nothing. Boxes move to their page once: to so many tasks, where shuffle partitions are too few for them.
    """
    boxes = boxes.repartition(tasks, "doc", "page") if tasks else boxes
    page = W.partitionBy("doc", "page")
    beside = page.orderBy("top").rangeBetween(-5, 5)
    near = lambda test: F.max(F.when(test, F.col("top")).otherwise(None)).over(beside).isNotNull()
    has = boxes.withColumns({"_a": near(F.col("text") == "Allocation"), "_t": near(F.contains("text", F.lit("100.0%")))})
    has = has.withColumn("_y", F.min(F.when((F.col("text") == "Asset") & F.col("_a"), F.col("top"))).over(page))
    end = F.min(F.when((F.col("text") == "Total") & F.col("_t") & (F.col("top") > F.col("_y")), F.col("top"))).over(page)
    has = has.withColumn("_end", F.coalesce(end, F.col("_y") + reach))
    kept = has.where((F.col("top") > F.col("_y") + 5) & (F.col("top") < F.col("_end")) & (F.col("x0") < right))
    lines = boxes_to_lines(kept.drop("_a", "_t", "_y", "_end"), 0.0, grid=grid)
    rows = allocation(lines.withColumn("_key", F.struct("doc", "page")), "_key", "y", "text")
    return rows.select("_key.doc", "_key.page", "label", "pct")


def holdings_lines(lines: DataFrame, key: str, heading: str = "Security Name", stops: Sequence[str] = ("Distribution", "Notes:"), k: int = 5, least: int = 4, pos: str = "pos", text: str = "line") -> DataFrame:
    """The first k names below a heading, with rank: what stands after the heading on its own line counts; lines of fewer than least characters or of numbers only don't; a line with a stop ends the list."""
    w = W.partitionBy(key)
    opened = lines.withColumn("_s", F.min(F.when(F.contains(text, F.lit(heading)), F.col(pos))).over(w)).where(F.col(pos) >= F.col("_s"))
    stop = reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in stops), F.lit(False))
    closed = opened.withColumn("_e", F.min(F.when((F.col(pos) > F.col("_s")) & stop, F.col(pos))).over(w)).where(F.col("_e").isNull() | (F.col(pos) < F.col("_e")))
    name = F.trim(F.when(F.col(pos) == F.col("_s"), F.substring_index(text, heading, -1)).otherwise(F.col(text)))
    good = closed.withColumn("_n", name).where((F.length("_n") >= least) & ~F.col("_n").rlike(r"^[\d.%\-\s]+$"))
    ranked = good.withColumn("rank", F.row_number().over(w.orderBy(pos))).where(F.col("rank") <= k)
    return ranked.select(key, "rank", F.col("_n").alias("name"))
