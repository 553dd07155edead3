"""Readers and writers: explicit schemas, rejects beside good rows, newest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quayside.functions.scalars import pair_list, split_list
from quayside.sources.versions import Versions, kept_on_failure

RETURNS = "map<string, struct<fund: double, bench: double, alpha: double>>"
SNAPSHOT = f"all_funds array<struct<name: string, abbr: string, source_file: string, asset_class: string, geography: string, is_shariah: boolean, period_detail: {RETURNS}, outperform_count: int, total_periods: int, outperform_rate: double>>, base_dir string"
PROFILE = "client_name string, risk_level string, shariah boolean, experience string, upfront_capital_rm double, target_annual_return_pct double, goals string"
EVENT = "date string, theme string, claim string, source_url string"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def nested_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per fund of JSON files that hold a list of funds; keys that a file lacks are null. row_seq is the place in the file."""
    rows = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    return rows.select("base_dir", F.posexplode("all_funds").alias("row_seq", "fund")).select("row_seq", "fund.*", "base_dir")


def state_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one before its first write; asked of Spark's own file system, so any store will do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def dimension(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Key and value without nulls; of a key's rows the last by seq counts."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, seq).alias(value))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path, multiLine=True)


def code_map(spark: SparkSession, path: str) -> DataFrame:
    """abbr, code and the day they were fetched, of a JSON map."""
    return spark.read.schema("fetched string, count int, codes map<string,string>").json(path, multiLine=True).select("fetched", F.explode("codes").alias("abbr", "code"))


def delimited(lines: DataFrame, schema: T.StructType, line: str = "value", mark: str = r"\|") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects (line and reason) of delimited text: a wrong number of fields or a value that can't be cast goes to the rejects, the rest goes on."""
    parts = lines.withColumn("_p", F.transform(F.split(line, mark, -1), lambda p: F.trim(p)))
    names = [f.name for f in schema.fields]
    cast = parts.select("*", *(F.get("_p", i).try_cast(f.dataType).alias(f"_c{i}") for i, f in enumerate(schema.fields)))
    bad = [F.when((F.get("_p", i) != "") & F.col(f"_c{i}").isNull(), F.lit(n)) for i, n in enumerate(names)]
    reason = F.when(F.size("_p") != len(names), F.concat(F.lit("fields: "), F.size("_p"))).otherwise(F.coalesce(*bad))
    told = cast.withColumn("_reason", reason)
    good = told.where(F.col("_reason").isNull()).select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))
    return good, told.where(F.col("_reason").isNotNull()).select(F.col(line).alias("line"), F.col("_reason").alias("reason"))


def events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dated events and rejects, of JSON with keys that may be unknown: rejects lack a required one."""
    rows = spark.read.schema(f"events array<struct<{', '.join(x.replace(' ', ': ') for x in EVENT.split(', '))}>>, exposure_gaps array<string>").json(path, multiLine=True).select(F.explode("events").alias("e")).select("e.*")
    whole = F.col("date").isNotNull() & F.col("theme").isNotNull() & F.col("claim").isNotNull()
    return rows.where(whole), rows.where(~whole)


def month_number(name: Column) -> Column:
    """1 to 12 of a three-letter month, else 0."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(name)).cast("int")


def files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths that match, as rows; contents aren't read."""
    return spark.read.format("binaryFile").load(glob).select("path")


def latest_per_series(paths: DataFrame, pattern: str = r"\[MFR ([A-Za-z]{3})(\d{2})\] (.+)\.pdf$", without: str | None = None) -> DataFrame:
    """series, path of each series' newest report by the month and year in its name; of equal ones the first path. Other names are passed over."""
    rows = paths if without is None else paths.where(~F.col("path").contains(without))
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = rows.where(F.col("path").rlike(pattern)).select("path", part(3).alias("series"), (part(2).cast("int") * 100 + month_number(part(1))).alias("key"))
    best = F.row_number().over(W.partitionBy("series").orderBy(F.desc("key"), "path")) == 1
    return rows.withColumn("best", best).where("best").select("series", "path", "key")


def newest_version(paths: DataFrame, pattern: str = r"_([A-Za-z]{3})(\d{4})_v(\d+)\.(\d+)") -> DataFrame:
    """The newest path (dir_prio, path) by year, month and version in its name, of the first directory that has any: one row."""
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = paths.where(F.col("path").rlike(pattern))
    key = F.struct(-F.col("dir_prio"), part(2).cast("int"), month_number(part(1)), part(3).cast("int"), part(4).cast("int"))
    return rows.agg(F.max_by("path", key).alias("path"))


def vintage(funds: DataFrame, pattern: str = r"\[MFR ([A-Za-z]{3})(\d{2})\]") -> DataFrame:
    """One row: the report month of the first fund whose source file names one, as 'JAN2024'; Unknown if none does."""
    month = F.concat(F.upper(F.regexp_extract("source_file", pattern, 1)), F.lit("20"), F.regexp_extract("source_file", pattern, 2))
    return funds.agg(F.coalesce(F.min_by(month, F.when(F.col("source_file").rlike(pattern), F.col("row_seq"))), F.lit("Unknown")).alias("vintage"))


def with_fallback(rows: DataFrame, lookup: DataFrame, key: str, value: str, form) -> DataFrame:
    """Adds value by the exact key, else by the key in one form; with neither it is null. Equal forms in lookup: the least key counts."""
    exact = lookup.select(F.col(key).alias("_k"), F.col(value).alias("_exact"))
    loose = lookup.groupBy(form(F.col(key)).alias("_f")).agg(F.min_by(value, key).alias("_loose"))
    met = rows.join(exact, rows[key] == F.col("_k"), "left").join(loose, form(rows[key]) == F.col("_f"), "left")
    return met.select(*rows.columns, F.coalesce("_exact", "_loose").alias(value))


def write_master(rows: DataFrame, path: str, month: str = "report_month", csv: bool = False) -> None:
    """The master table by report month: a month that rows hold is replaced, all others stay. Rows of a month are brought together before, so a month is a file or a few and not one of every task. Or as text with a header for people, which is replaced as a whole."""
    if csv:
        rows.write.mode("overwrite").csv(path, header=True)
    else:
        rows.hint("rebalance", F.col(month)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def write_state(rows: DataFrame, errors: DataFrame, path: str, version: int, key: str = "fund_id") -> bool:
    """A version of a state table with what failed in the run; rows that the run couldn't fetch stay as they were in the version before. See Versions: a run that dies leaves that version as it is."""
    versions = Versions(rows.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return versions.write(version, {"state": kept_on_failure(versions.read(schema, ["state"], before=version), rows, key), "errors": errors})


__all__ = ["code_map", "delimited", "dimension", "events", "files", "latest_per_series", "nested_snapshot", "newest_version", "pair_list", "profiles", "split_list", "state_or_empty", "vintage", "with_fallback", "write_master", "write_state"]
