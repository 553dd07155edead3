"""Lines that many documents share, dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLANKS, ascii_lower, cut, keep_others

OWN = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Adds n_lines (before dropping), n_dropped and kept_text to docs (doc_id, text).

    A text splits at \\n; null or empty text is one empty line. Keys (lines
    stripped of blanks, A-Z lowered) of min_chars code points or more that are
    in min_docs documents or more lose all their lines except in the largest
    doc_id. Every input row gives one row: rows that repeat a doc_id count as
    one document, and so do all rows whose doc_id is null, which is smaller than
    any other. Input columns named as the new ones give way to them.

    Only hashes and ids of long lines are shuffled to count documents, first by
    (hash, doc_id) and then, pre-aggregated, by hash; so a line in a third of all
    rows is spread. The texts move once, to meet the positions they lose.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    long = rows.where(F.length("line") >= min_chars).select("doc_id", "text_hash", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    # two 64-bit hashes of other seeds: at 1e12 lines one alone would collide
    long = long.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(9), "key").alias("h2"))
    holders = long.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    shared = cut(holders.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "shared-lines")
    # both sides are plain exchanges, so adaptive execution can split a hot line
    lost = long.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "text_hash", "pos")
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("lost")).select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "lost")
    split = docs.select(
        F.struct(*keep_others(docs, *OWN)).alias("row"),
        F.col("doc_id").cast("long").alias("own_id"),
        F.xxhash64(text).alias("own_hash"),
        F.split(text, "\n", -1).alias("lines"),
    )
    met = split.join(lost, F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_hash") == F.col("lost_hash")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    made = F.struct(F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return met.select("row", made.alias("made")).select("row.*", "made.*")  # apart, so that no column of the row is taken for one of these


def without_shared_lines(docs: DataFrame, **options: int) -> DataFrame:
    """docs with kept_text in the place of text; a text that loses all its lines becomes empty.

    A null text stays null and n_chars, if there, is counted anew.
    """
    out = line_dedup(docs, **options)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    columns = {c.lower(): F.col(f"`{c}`") for c in docs.columns} | {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*(columns[c.lower()].alias(c) for c in docs.columns))


#: DuckDB SQL: lines of each document (doc_id, pos, line, key, drop) of a relation {docs}.
LINES_SQL = r"""
lines AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM {docs})),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> s.keeper, false) AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key)
"""
SQL = "WITH" + LINES_SQL.format(docs="documents") + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
