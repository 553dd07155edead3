"""Near duplicates by SimHash: fingerprints that differ in at most two bits are linked, and links make components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import cut, drop, keep_others

#: Four segments of 16 bits, two differing bits.
SEGMENTS, WIDTH, BITS = 4, 16, 2
#: Segment pairs that a chain of three can begin with or skip over: all six.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: Up to so many fingerprints that share two segments are compared in pairs; more are linked through common neighbours.
SMALL = 24
SALTS = 64


def fingerprint(text: str | None) -> int:
    """64 bits over the 3-word shingles of a text, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII blanks
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % three, 42) for three in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def _segment(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _differ(x: Column, y: Column, k: int) -> Column:
    return F.bit_count(_segment(x, k).bitwiseXOR(_segment(y, k)))


def _chain(x: Column, y: Column) -> Column:
    """The pigeonring condition: from some segment on, 1, 2, 3 and 4 segments in a row differ in at most 0, 1, 1 and 2 bits."""
    d = [_differ(x, y, k) for k in range(SEGMENTS)]
    starts = [(d[i] == 0) & (d[i] + d[(i + 1) % 4] <= 1) & (d[i] + d[(i + 1) % 4] + d[(i + 2) % 4] <= 1) for i in range(SEGMENTS)]
    return starts[0] | starts[1] | starts[2] | starts[3]


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a > b) of distinct fingerprints fp that connect all those within two bits, directly or through others.

    By the pigeonring principle the segments of such a pair hold a chain whose
    first segment is equal and whose next two differ in one bit at most, so two of
    the three are equal: candidates share two of four segments, 32 bits, and
    pass the chain condition before the full Hamming check. Up to SMALL
    fingerprints with the same two segments are compared in pairs. Where more share
    them, each is joined to what lies one bit away in the other two
    segments: two are within two bits just if they have such a neighbour in
    common, and a neighbour has 33 owners at most, so work stays linear in the
    group and no link is lost.
    """
    wide = [F.struct(F.lit(n).cast("long").alias("pair"), (_segment(F.col("fp"), a) * (1 << WIDTH) + _segment(F.col("fp"), b)).alias("bits")) for n, (a, b) in enumerate(PAIRS)]
    keyed = prints.select("fp", F.explode(F.array(*wide)).alias("key")).select("fp", "key.pair", "key.bits")
    large = keyed.groupBy("pair", "bits").count().where(F.col("count") > SMALL).select("pair", "bits")
    large = cut(large, "large-groups").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
    told = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(large, ["pair", "bits", "salt"], "left")
    told = cut(told.select("fp", "pair", "bits", F.coalesce("large", F.lit(False)).alias("large")), "segment-keys")
    # small groups: at most SMALL rows each, so the list and the pairs are bounded
    few = told.where(~F.col("large")).groupBy("pair", "bits").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    mates = lambda i: F.transform(F.filter(F.col("fps"), lambda y: (y < F.get("fps", i)) & _chain(F.get("fps", i), y) & (F.bit_count(F.get("fps", i).bitwiseXOR(y)) <= BITS)), lambda y: F.struct(F.get("fps", i).alias("a"), y.alias("b")))
    direct = few.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("fps") - 1), mates))).alias("link")).select("link.a", "link.b")
    flips = [F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << (WIDTH * k + bit))) for k in range(SEGMENTS) if k not in pair for bit in range(WIDTH))) for pair in PAIRS]
    near = told.where("large").withColumn("flip", F.explode(F.element_at(F.array(*flips), (F.col("pair") + 1).cast("int"))))
    near = near.groupBy("pair", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps"))
    through = near.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), "b").where("a <> b")
    return direct.unionByName(through).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b). Nodes without an edge aren't listed.

    Large-star and small-star steps in turn until nothing changes (their number grows with the logarithm of the longest path; if
    rounds aren't enough, that is an error); each step's
    table is written to the shared folder. Both sides of its join are plain
    tables there, so adaptive execution can split the rows of a hub.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "least")
        star = both.where("b > a").join(least, both.a == least.node).select(F.col("b").alias("a"), F.col("root").alias("b"))  # large-star
        large = cut(star.unionByName(least.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).where("a <> b").distinct(), "large-star")
        lower = cut(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "lower")
        star = large.join(lower, large.a == lower.node).select(F.col("b").alias("a"), F.col("root").alias("b"))  # small-star
        small = cut(star.unionByName(lower.select(F.col("node").alias("a"), F.col("root").alias("b"))).where("a <> b").distinct(), "small-star")
        for old in (edges, least, large, lower):
            drop(old)
        edges = small
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over linked fingerprints, for each row of docs (doc_id, text).

    A null or blank text has the fingerprint zero and is linked like any other.
    Rows that repeat a doc_id stay, each with its own fingerprint. A row whose
    doc_id is null counts as any other but is never a component's smallest id; a
    component of such rows alone has a null component_id.
    """
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(F.col("text")).alias("fp")), "fingerprints")
    return _grouped(prints)


def _grouped(prints: DataFrame) -> DataFrame:
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    classes = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = cut(classes.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id. Of rows that repeat it, one stays; rows without an id stay."""
    groups = simhash_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("component_id").alias("kept_id")).distinct()
    whole = docs.select(F.struct(*keep_others(docs)).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    whole = whole.join(kept, F.col("own_id") == F.col("kept_id"), "left").where(F.col("kept_id").isNotNull() | F.col("own_id").isNull())
    nameless = F.when(F.col("own_id").isNull(), F.monotonically_increasing_id()).alias("nameless")
    return whole.select("row", "own_id", nameless).dropDuplicates(["own_id", "nameless"]).select("row.*")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
