"""The master table: its reader, its wide rows, which of its funds are for retail clients, and how codes, highs and sources meet it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.config import NAMED_PLACES, PERIODS, SECTOR_BUCKETS
from quayside.functions.scalars import band_up_to, clean_name, distribution, fund_type_or, half_up, number, split_list, truthy
from quayside.operators.measures import efficiency
from quayside.operators.screening import bucket_pivot, rationale


def retail(name: Column, code: Column, wholesale: Sequence[str] = (), prefix: str = "PB ", suffix: str = "-B") -> Column:
    """Whether a fund is for retail clients: it has a name and a code, is of no series of its own by the name's start or the code's end, and isn't on the list."""
    out = name.isNotNull() & code.isNotNull() & ~name.startswith(prefix) & ~code.endswith(suffix)
    return F.coalesce(out & ~code.isin(*wholesale) if wholesale else out, F.lit(False))


def retail_only(funds: DataFrame, wholesale: DataFrame | None = None, name: str = "name", code: str = "code") -> DataFrame:
    """The funds for retail clients; wholesale: a table of codes, of any size."""
    kept = funds.where(retail(F.col(name), F.col(code)))
    return kept if wholesale is None else kept.join(wholesale.select(code), code, "left_anti")


def master_rows(cells: DataFrame, row: str = "row", assets: Sequence[str] = (), places: Sequence[str] = ()) -> DataFrame:
    """Typed, nested rows of a master table read as text (one column for each of its columns and its row number), up to the first row without a code.

    code, name, screened, fund_type, risk_level, status, weighted_alpha, returns (period: fund, bench, alpha), efficiency, assets, geo, top_holdings,
    volatility, peer_group, benchmark, drawdown, days_from_ath. A value that is no number is null, a missing column too. The
    first blank row is found by one aggregation over row numbers; nothing is read in order.
    """
    has = set(cells.columns)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c in has else F.lit(None).cast("string")
    num = lambda c: number(text(c))
    numbers = lambda names, form: F.create_map(*(x for n in names for x in (F.lit(n), num(form.format(n))))) if names else F.create_map().cast("map<string,double>")
    stop = F.broadcast(cells.where(text("code").isNull()).agg(F.min(row).alias("_stop")))  # one row
    kept = cells.join(stop, F.lit(True)).where(F.col("_stop").isNull() | (F.col(row) < F.col("_stop")))
    returns = F.create_map(*(x for p in PERIODS for x in (F.lit(p), F.struct(*(num(f"{p}_{part}").alias(part) for part in ("fund", "bench", "alpha"))))))
    return kept.select(
        F.col(row), text("code").alias("code"), F.coalesce(text("name"), F.lit("")).alias("name"), truthy(text("series")).alias("screened"), text("fund_type").alias("fund_type"), num("risk_level").cast("int").alias("risk_level"),
        text("status").alias("status"), num("weighted_alpha").alias("weighted_alpha"), returns.alias("returns"), numbers(PERIODS, "efficiency_{}").alias("efficiency"), numbers(list(assets), "{}").alias("assets"), numbers(list(places), "{} (%)").alias("geo"),
        F.coalesce(split_list(text("top_holdings")), F.array().cast("array<string>")).alias("top_holdings"), num("volatility").alias("volatility"), text("peer_group").alias("peer_group"), text("benchmark").alias("benchmark"), num("drawdown").alias("drawdown"), num("days_from_ath").cast("int").alias("days_from_ath"),
    )


def percent(text: Column) -> Column:
    """'12.5%' as 12.5; what is no number counts as 0."""
    return F.coalesce(number(F.replace(text, F.lit("%"), F.lit(""))), F.lit(0.0))


def sector_buckets(entries: DataFrame, key: str = "fund_id", sector: str = "sector", weight: str = "weight", buckets: Mapping[str, str] = SECTOR_BUCKETS, rest: str = "Other Sector") -> DataFrame:
    """One row per key and a column for each bucket of sectors: weights are texts such as '12.5%', unknown sectors go to the rest."""
    names = [b for b in dict.fromkeys(buckets.values()) if b != rest]
    return bucket_pivot(entries.withColumn("_w", percent(F.col(weight)).cast("decimal(18,4)")), key, sector, "_w", {k: v for k, v in buckets.items() if v != rest}, names, rest)


def country_buckets(entries: DataFrame, key: str = "fund_id", place: str = "place", share: str = "share", named: Sequence[str] = NAMED_PLACES, rest: str = "Geo Other") -> DataFrame:
    """One row per key, a column for each named place (null where the fund has none) and the sum of all others in the rest, which is null unless it is positive; 1 digit."""
    wide = entries.groupBy(key).agg(*(F.max(F.when(F.col(place) == n, F.col(share))).cast("double").alias(n) for n in named), F.sum(F.when(~F.col(place).isin(*named), F.col(share).cast("decimal(18,4)"))).cast("double").alias("_rest"))
    return wide.select(key, *(half_up(f"`{n}`", 1).alias(n) for n in named), half_up(F.when(F.col("_rest") > 0, F.col("_rest")), 1).alias(rest))


def top_texts(entries: DataFrame, key: str, name: str, weight: str, label: str, top: int = 5) -> DataFrame:
    """key, label: the names of a key's heaviest entries with their percents, 'Bank (12.5%) | Energy (3.0%)'; equal weights by name. A key's entries are what a report lists, so they are few."""
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(name).alias("n")))), 1, top)
    return entries.groupBy(key).agg(F.array_join(F.transform(first, lambda e: F.concat(e["n"], F.lit(" ("), F.format_string("%.1f", half_up(-e["w"], 1)), F.lit("%)"))), " | ").alias(label))


#: Columns of a fund that the master table shows as they are, after its figures.
DETAILS = ("top_holdings", "top_sectors", "volatility", "volatility_class", "peer_group", "benchmark", "source_file")


def wide_rows(funds: DataFrame, screened: DataFrame, alphas: DataFrame, assets: DataFrame | None = None, places: DataFrame | None = None, sectors: DataFrame | None = None, highs: DataFrame | None = None, key: str = "fund_id") -> DataFrame:
    """The master table, one row for each fund: details, screening, five periods of fund, benchmark and alpha, efficiency, shares by asset, place and sector, and highs.

    funds: key, name, code, screened, category, asset_class, geography, objective, risk_level, policy, volatility, and as far as it has them the other DETAILS: lists of top holdings and sectors are
    joined by bars, the class of volatility follows from the figure where it isn't given, what is missing is null; screened as screen() gives it; alphas as period_alpha() does; the others hold one row
    for each key (bucket_pivot(), sector_buckets(), country_buckets(), with_highs()). Periods are columns by name, so no job looks for them. All tables meet on the key: one partitioning serves every join, and
    tables that are stored in buckets of it (stored.co_partitioned()) need none.
    """
    of = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = alphas.groupBy(key).agg(*(of(p, c).alias(f"{p}_{name}") for p in PERIODS for c, name in (("fund_ret", "fund"), ("bench_ret", "bench"), ("alpha", "alpha"))))
    out = funds.join(screened.select(key, "weighted_alpha", "out_periods", "total_periods", "rate", "qualified"), key, "left").join(wide, key, "left")
    status = F.when(F.coalesce("qualified", F.lit(False)), "Qualified").otherwise("Disqualified")
    made = {
        "name": clean_name(F.col("name")), "series": F.when(F.col("screened"), "Shariah").otherwise("Conventional"), "fund_type": fund_type_or(F.col("category"), F.col("asset_class")), "distribution": distribution(F.col("policy")),
        "status": status, "periods": F.concat(F.coalesce("out_periods", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("total_periods", F.lit(0)).cast("string")), "rationale": rationale(status, F.col("weighted_alpha"), {p: F.col(f"{p}_alpha") for p in PERIODS}),
        **{f"efficiency_{p}": half_up(efficiency(F.col(f"{p}_alpha"), F.col("volatility")), 2) for p in PERIODS},
    }
    columns = [key, "name", "code", "series", "fund_type", "geography", "objective", "risk_level", "distribution", "status", "rate", "periods", "rationale", "weighted_alpha", *(f"{p}_{x}" for p in PERIODS for x in ("fund", "bench", "alpha")), *(f"efficiency_{p}" for p in PERIODS), *DETAILS]
    types = {f.name: f.dataType.typeName() for f in funds.schema}
    for c in DETAILS:
        if types.get(c) == "array":
            made[c] = F.array_join(F.coalesce(c, F.array().cast("array<string>")), " | ")
        elif c not in types:
            made[c] = band_up_to(F.col("volatility")) if c == "volatility_class" else F.lit(None).cast("string")
    out = out.select(*(made[c].alias(c) if c in made else F.col(c) for c in columns))
    for prefix, more in (("Asset", assets), ("Geo", places), ("Sector", sectors)):
        if more is not None:
            out = out.join(more.select(key, *(F.col(f"`{c}`").alias(f"{prefix}: {c}") for c in more.columns if c != key)), key, "left")
    return out if highs is None else with_highs(out, highs, key)


def with_highs(funds: DataFrame, highs: DataFrame, key: str = "fund_id") -> DataFrame:
    """funds with ath_nav, ath_date, current_nav, drawdown_pct and days_from_ath by the exact key; null where there are none."""
    return funds.join(highs.select(key, "ath_nav", "ath_date", "current_nav", "drawdown_pct", "days_from_ath"), key, "left")


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys that are wanted and not known, each once; null is no key."""
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")


def resolved_codes(wanted: DataFrame, codes: DataFrame, key: str, value: str, form: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """key, value and exact (whether the key was found as it is written) of the wanted keys, and those that aren't found even in one form.

    A key in its form meets all keys of the map that have it; of those the least counts.
    """
    keys = wanted.where(F.col(key).isNotNull()).select(F.col(key), form(F.col(key)).alias("_f")).distinct()
    exact = codes.select(F.col(key), F.col(value).alias("_exact"))
    loose = codes.groupBy(form(F.col(key)).alias("_f")).agg(F.min_by(value, key).alias("_loose"))
    met = keys.join(exact, key, "left").join(loose, "_f", "left")
    found = F.coalesce("_exact", "_loose")
    return met.where(found.isNotNull()).select(key, found.alias(value), F.col("_exact").isNotNull().alias("exact")), met.where(found.isNull()).select(key)


def first_seen(rows: DataFrame, key: str, pos: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with the first by pos of each key (within by); a null or empty key is passed over. Each task keeps one row of a key before the shuffle."""
    nth = F.row_number().over(W.partitionBy(*by, key).orderBy(pos))
    return rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


def source_list(holdings: DataFrame, events: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """key, pos, kind and text of a document's sources: a sheet for each holding (key, pos, code) in its order, then each address of the events (key, pos, source_url, theme, date) once, told by the first event that has it."""
    sheets = holdings.select(key, F.lit(0).alias("part"), "pos", F.lit("sheet").alias("kind"), F.col("code").alias("text"))
    told = F.concat(F.col("source_url"), F.lit(" "), F.coalesce("theme", F.lit("")), F.lit(" ("), F.coalesce("date", F.lit("")), F.lit(")"))
    links = first_seen(events, "source_url", "pos", [key]).select(key, F.lit(1).alias("part"), "pos", F.lit("link").alias("kind"), told.alias("text"))
    order = F.row_number().over(W.partitionBy(key).orderBy("part", "pos"))
    return sheets.unionByName(links).select(key, order.alias("pos"), "kind", "text")


def fund_universe(eligible: DataFrame, held: DataFrame, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """Codes that a portfolio may hold: eligible ones and those that are held already, each once."""
    return eligible.select(*by, code).unionByName(held.select(*by, code)).where(F.col(code).isNotNull()).distinct()
