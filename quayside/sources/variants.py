"""JSON documents as variants: whatever keys they have is kept, and what can't be read becomes a reject beside the rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.rows import computed

#: Fields of a fund in a snapshot, and of an event.
FUND = {"name": "string", "abbr": "string", "source_file": "string", "asset_class": "string", "geography": "string", "is_shariah": "boolean", "outperform_count": "int", "total_periods": "int", "outperform_rate": "double"}
EVENT = {"date": "string", "theme": "string", "claim": "string", "source_url": "string"}
PROFILE = {"client_name": "string", "risk_level": "string", "shariah": "boolean", "experience": "string", "upfront_capital_rm": "double", "target_annual_return_pct": "double", "goals": "string"}


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """path and doc (variant) of each file below a path that is JSON; path and reason of those that aren't. A file of no bytes is passed over by Spark's readers."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    files = computed(files, doc=F.try_parse_json("value")).drop("value")  # parsed once, not for each test and field of it
    return files.where(F.col("doc").isNotNull()), files.where(F.col("doc").isNull()).select("path", F.lit("no JSON").alias("reason"))


def elements(docs: DataFrame, where: str, keep: tuple[str, ...] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """keep, row_seq and item (variant) of each element of the list at a path of doc; path and reason of documents without such a list. Null elements are none."""
    listed = computed(docs.select("path", "doc", *(c for c in keep if c not in ("path", "doc"))), _items=F.try_variant_get("doc", where, "array<variant>")).drop("doc")
    good = listed.where(F.col("_items").isNotNull()).select(*keep, F.posexplode("_items").alias("row_seq", "item")).where(~F.is_variant_null("item"))
    return good, listed.where(F.col("_items").isNull()).select("path", F.lit(f"no list at {where}").alias("reason"))


def typed(items: DataFrame, fields: Mapping[str, str], required: tuple[str, ...] = (), item: str = "item") -> tuple[DataFrame, DataFrame]:
    """items with a column for each field, and unknown: the other keys with their values (map of variants). Rejects have also reason: a required field that is missing, or one whose value isn't of its type."""
    whole = F.try_variant_get(item, "$", "map<string, variant>")
    rows = computed(items, _keys=whole, **{name: F.try_variant_get(item, f"$.{name}", kind) for name, kind in fields.items()})
    value = lambda name: F.try_element_at("_keys", F.lit(name))
    given = lambda name: value(name).isNotNull() & ~F.is_variant_null(value(name))
    wrong = [F.when(F.col(name).isNull() & given(name), F.lit(f"{name} isn't {kind}")) for name, kind in fields.items()]
    lacking = [F.when(F.col(name).isNull(), F.lit(f"{name} is missing")) for name in required]
    reason = F.when(F.col("_keys").isNull(), "no object").otherwise(F.coalesce(*wrong, *lacking, F.lit(None)))
    told = rows.withColumn("reason", reason).withColumn("unknown", F.map_filter("_keys", lambda k, _: ~k.isin(*fields))).drop("_keys")
    return told.where(F.col("reason").isNull()).drop("reason"), told.where(F.col("reason").isNotNull())


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The funds of snapshot files (path, base_dir, row_seq, the fields of FUND, period_detail as a map of variants, unknown), and rejects (path, row_seq, reason): files that aren't JSON or hold no list, funds with a field of another type. One bad file or fund stops nothing."""
    docs, broken = documents(spark, path)
    docs = docs.withColumn("base_dir", F.try_variant_get("doc", "$.base_dir", "string"))
    items, listless = elements(docs, "$.all_funds", ("path", "base_dir"))
    items = items.withColumn("period_detail", F.try_variant_get("item", "$.period_detail", "map<string, variant>"))
    good, bad = typed(items, FUND)
    files = broken.unionByName(listless).withColumn("row_seq", F.lit(None).cast("int"))
    known = F.map_filter("unknown", lambda k, _: k != "period_detail")
    return good.withColumn("unknown", known).drop("item"), files.unionByName(bad.select("path", "reason", "row_seq"))


def profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Clients' profiles (path, the fields of PROFILE, unknown), and rejects (path, reason). A file holds one profile or a list of them; null elements are none, and a list without any other is a reject."""
    docs, broken = documents(spark, path)
    docs = computed(docs, _items=F.filter(F.try_variant_get("doc", "$", "array<variant>"), lambda x: ~F.is_variant_null(x)))
    items = docs.select("path", F.explode(F.when(F.size("_items") > 0, F.col("_items")).otherwise(F.array("doc"))).alias("item"))
    good, bad = typed(items, PROFILE)
    return good.drop("item"), broken.unionByName(bad.select("path", "reason"))


def events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dated events (path, row_seq, the fields of EVENT, unknown), and rejects (path, row_seq, reason): also those without a date, a theme or a claim."""
    docs, broken = documents(spark, path)
    items, listless = elements(docs, "$.events")
    good, bad = typed(items, EVENT, ("date", "theme", "claim"))
    files = broken.unionByName(listless).withColumn("row_seq", F.lit(None).cast("int"))
    return good.drop("item"), files.unionByName(bad.select("path", "reason", "row_seq"))
