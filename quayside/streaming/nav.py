"""All-time highs kept up to date from a stream of price files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators.nav import DAYS, KEY, NAV, STATE, WHEN, all_time_high, counted, day_sets, merged, merged_days
from quayside.sources.versions import Versions, bucket_of

SCHEMA = "fund_id long, nav_date date, nav double"
#: Buckets of a state table; a batch rewrites those of its funds.
BUCKETS = 64


def points_stream(spark: SparkSession, folder: str, late: str | None = None) -> DataFrame:
    """Price files that arrive in a folder. With late a day that comes again within that time is dropped, for running_high(); keep_state() needs none of it, for its days are sets."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("at", F.col(WHEN).cast("timestamp"))
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([KEY, WHEN]) if late else stream


def keep_state(points: DataFrame, table: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS, keep: int = 2) -> StreamingQuery:
    """Merges each batch into the highs and the days seen, two tables in versions below a folder: highs and days.

    A batch rewrites the buckets of its own funds; the version of a batch is one manifest for each table, and a batch that comes again after a failure finds its version
    there, or writes it from the same version before. Highs don't change when a point comes again, and days are sets, so points counts distinct days whatever
    is replayed and however late. The last `keep` versions stay.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        highs, days = Versions(spark, f"{table}/highs"), Versions(spark, f"{table}/days")
        batch = batch.select(KEY, WHEN, NAV, bucket_of(KEY, buckets).alias("bucket")).persist()
        try:
            touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most buckets
            names = [str(b) for b in touched]
            seen = merged_days(days.read(DAYS, names, before=n), day_sets(batch))
            days.write_buckets(n, seen.withColumn("bucket", bucket_of(KEY, buckets)), "bucket", touched)
            new = counted(merged(highs.read(STATE, names, before=n), all_time_high(batch)), days.read(DAYS, names, before=n + 1))
            highs.write_buckets(n, new.withColumn("bucket", bucket_of(KEY, buckets)), "bucket", touched)
        finally:
            batch.unpersist()
        highs.vacuum(keep)
        days.vacuum(keep)

    writer = points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_high(points: DataFrame) -> DataFrame:
    """Highs as a streaming aggregate, for outputMode('update'): one row of state per fund, whatever the history."""
    top = F.max(F.when(F.col(NAV).isNotNull(), F.struct(F.col(NAV).alias("nav"), (-F.unix_date(WHEN)).alias("before")))).alias("top")
    out = points.groupBy(KEY).agg(top, F.count(F.lit(1)).alias("points"))
    return out.select(KEY, F.col("top.nav").alias("ath_nav"), F.date_from_unix_date(-F.col("top.before")).alias("ath_date"), "points")
