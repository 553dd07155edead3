"""Tables that share a key, stored in the same buckets of it, so that they meet without a shuffle; and reports in files whose names tell which of them have to be opened."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.tables import month_number

REPORT = r"\[MFR ([A-Za-z]{3})(\d{2})\] (.+)\.txt$"


def co_partitioned(tables: Mapping[str, DataFrame], key: str, folder: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables, each written below folder in the same number of buckets of its key and read back: joins and groupings by the key read them as they lie.

    They are for tables in which a key has few rows, such as one for each fund and period: a bucket is read by one task. The number of buckets is that of shuffle
    partitions unless it is given; at most a few hundred megabytes of the largest table should come into one. Each bucket is one file, and a lookup of a key opens one.
    Rows whose key is null are kept, in one bucket. Names in the catalog are new in each call; the files stay in folder.
    """
    out, run = {}, uuid.uuid4().hex
    for name, rows in tables.items():
        spark = rows.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        at = f"stored_{run}_{name}"
        rows.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(at)
        out[name] = spark.table(at)
    return out


def _path() -> Column:
    """The file of a row as it is named, not as an address writes it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _told(path: Column, pattern: str) -> tuple[Column, Column]:
    part = lambda i: F.regexp_extract(path, pattern, i)
    return part(3), part(2).cast("int") * 100 + month_number(part(1))


def reports(spark: SparkSession, folder: str, series: Sequence[str] = (), since: int | None = None, until: int | None = None, pattern: str = REPORT) -> DataFrame:
    """series, key (year and month, 2401), path and line of text reports below a folder, of the series and months that are asked for, both ends included; all where nothing is.

    The three groups of pattern are month, year and series, at the end of the path. These conditions are on the file alone, so Spark drops files by them when it lists them: other files are never opened, of
    whatever number, and no path is listed by name in the plan. Files whose name isn't that of a report are passed over. An unknown month counts as 0.
    """
    name, key = _told(_path(), pattern)
    asked = _path().rlike(pattern)
    if series:
        asked = asked & name.isin(*series)
    if since is not None:
        asked = asked & (key >= since)
    if until is not None:
        asked = asked & (key <= until)
    rows = spark.read.option("recursiveFileLookup", True).text(folder)
    return rows.where(asked).select(name.alias("series"), key.alias("key"), _path().alias("path"), F.col("value").alias("line"))


def latest_reports(spark: SparkSession, folder: str, series: Sequence[str] = (), pattern: str = REPORT) -> DataFrame:
    """The rows of reports() in the newest file of each series, of equally new ones the first path.

    The newest are told from names alone. One number reaches the driver, the month of the series that is furthest behind; files that are older are never opened, and of the others a
    join by path keeps the newest.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name, key = _told(_path(), pattern)
    wanted = listed.where(_path().rlike(pattern) & name.isin(*series) if series else _path().rlike(pattern))
    best = wanted.select(name.alias("series"), F.struct(-key, _path().alias("path")).alias("_at")).groupBy("series").agg(F.min("_at").alias("_at")).select((-F.col("_at.col1")).alias("_key"), F.col("_at.path").alias("path"))
    oldest = best.agg(F.min("_key")).first()[0]
    return reports(spark, folder, series, since=oldest, pattern=pattern).join(best.select("path"), "path", "left_semi").select("series", "key", "path", "line")
