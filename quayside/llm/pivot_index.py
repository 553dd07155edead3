"""Near duplicates of embeddings by a pivot-permutation index.

A vector is described by its KEPT nearest pivots in order. An inverted list for each (label, pivot) holds the vectors
that name it; two vectors are compared if they share SHARED pivots at least. Pivots are numbered from the rarest on,
and vectors stand in the lists of their first KEPT - SHARED + 1 only: two that share SHARED meet in the list of the first pivot they
share, and are counted there alone. Long lists are split into blocks. Within a list shared pivots are counted by
a product of membership matrices, candidates are verified by their cosine, and what leaves a task is a row for each vector: how many it is linked with there and the least
vector that its links reach. No pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import block_pairs, by_group, cut, drop
from quayside.llm.simhash import components

#: Pivots that describe a vector, and those that two vectors share at least to be compared.
KEPT, SHARED = 12, 3
#: Pivots at least and at most, one for so many distinct vectors between; sampled vectors for each pivot.
PIVOTS, MOST_PIVOTS, PER_PIVOT, SAMPLED = 128, 2048, 64, 4
#: Pivots closer than that are not taken: within a group of near copies noise alone would decide which is the nearest.
APART = 0.8
#: Vectors of an inverted list that a task compares with as many others.
BLOCK = 1024


def usable(v: Column) -> Column:
    """Not null, not all zero, without null, infinite or undefined components."""
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled with zeros, each scaled by a power of two (which rounds nothing) so that squares neither overflow nor vanish."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    most = np.abs(out).max(axis=1, initial=0)
    return np.ldexp(out, -np.frexp(most)[1][:, None])


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def choose(sample: np.ndarray, n: int, width: int) -> np.ndarray:
    """Up to n directions of the sample, each the farthest from those before, while they are apart; random ones fill up to PIVOTS."""
    chosen = np.zeros((0, width))
    if len(sample):
        nearest = np.full(len(sample), -2.0)
        at = 0
        while len(chosen) < n:
            chosen = np.vstack([chosen, sample[at : at + 1]])
            nearest = np.maximum(nearest, sample @ sample[at])
            at = int(nearest.argmin())
            if nearest[at] >= APART:
                break
    fill = max(0, min(n, PIVOTS) - len(chosen))
    return np.vstack([chosen, directions(np.random.default_rng(7).normal(size=(fill, width)))])


def described(classes: DataFrame, pivots: np.ndarray, width: int, kept: int) -> DataFrame:
    """classes with near: the numbers of the kept nearest pivots, nearest first."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                products = directions(matrix(part["embedding"].to_pandas(), width)) @ pivots.T
                order = np.argsort(-products, axis=1, kind="stable")[:, :kept].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(near, f"{schema}, near array<int>")


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that edges (a, b) reach."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verifier(threshold: float, width: int, shared: int):
    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The vectors of one block of a list against those of another, or against each other."""
        pivot, i, j = key[1:]
        part = part.sort_values("cls", ignore_index=True)
        left = np.flatnonzero(part["block"] == i)
        right = left if i == j else np.flatnonzero(part["block"] == j)
        if not len(left) or not len(right) or len(part) < 2:
            return pd.DataFrame({"cls": [], "links": [], "root": []}, dtype="int64")
        names, at = np.unique(np.concatenate(part["ranks"].to_list()), return_inverse=True)
        member = np.zeros((len(part), len(names)), np.float32)
        member[np.repeat(np.arange(len(part)), part["ranks"].map(len)), at] = 1
        x = matrix(part["embedding"], width)
        length = np.sqrt((x**2).sum(axis=1))
        early = member[:, names < pivot]
        pairs = []
        for start in range(0, len(left), 256):
            rows = left[start : start + 256]
            # the number of shared pivots, and none of them before this list's
            wanted = (member[rows] @ member[right].T >= shared) & (early[rows] @ early[right].T == 0)
            if i == j:
                wanted &= rows[:, None] < right[None]
            r, c = np.nonzero(wanted)
            if len(r) * 8 > wanted.size:
                cosine = ((x[rows] @ x[right].T) / (length[rows][:, None] * length[right][None]))[r, c]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", x[rows[r[k : k + 65536]]], x[right[c[k : k + 65536]]]) for k in range(0, len(r), 65536)] or [np.zeros(0)]) / (length[rows[r]] * length[right[c]])
            close = np.flatnonzero(np.abs(cosine - threshold) < 1e-12)  # one formula for those that rounding could tip over
            for k in close:
                cosine[k] = (x[rows[r[k]]] * x[right[c[k]]]).sum() / (length[rows[r[k]]] * length[right[c[k]]])
            good = cosine >= threshold
            pairs.append((rows[r[good]], right[c[good]]))
        a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
        rows_of = part["n"].to_numpy()
        links = np.bincount(a, rows_of[b], len(part)) + np.bincount(b, rows_of[a], len(part))
        root = local_roots(a, b, len(part))
        cls, linked = part["cls"].to_numpy(), np.flatnonzero(links)
        return pd.DataFrame({"cls": cls[linked], "links": links[linked].astype(np.int64), "root": cls[root[linked]]})

    return verify


def near_vectors(vectors: DataFrame, threshold: float = 0.93, kept: int = KEPT, shared: int = SHARED, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Rows with equal labels are linked if their cosine, in double precision, is threshold or more. n_links counts the other rows that a row is linked with; component_id is the smallest vec_id that links reach, itself
    included; kept says whether a row has that id. A null label, and a vector that is null, zero or holds null, infinite or undefined components, has no
    links. Vectors of different lengths are compared as if the shorter went on with zeros. Equal vectors of a label are one entry with a count, so copies cost nothing;
    rows that repeat a vec_id count one by one. A null vec_id is never a component's, unless no other is in it; then component_id is null and the row is kept. Empty tables give no
    rows; columns other than these three are dropped.

    Every link that is given is verified. A link is missed only where two vectors share fewer than `shared` of their `kept` nearest pivots; recall() and the tests measure that. Pivots are
    chosen from a bounded sample, SAMPLED vectors for each, and with a counter for each are all that reaches the driver.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ready = usable(F.col("embedding")) & F.col("label").isNotNull()
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(9), "embedding").alias("h2")]
    classes = own.where(ready).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "label", "embedding", "n", "least"), "vector-classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    unlinked = own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        drop(classes)
        return unlinked
    width = int(size["width"])
    n = pivots or min(MOST_PIVOTS, max(PIVOTS, size["n"] // PER_PIVOT))
    sample = classes.orderBy(F.xxhash64("embedding"), "cls").limit(SAMPLED * n).select("embedding").toPandas()["embedding"]
    centres = choose(directions(matrix(sample, width)), n, width)
    # the classes by the number that each pivot has from the rarest on: lists that are looked at are the short ones
    near = cut(described(classes, centres, width, kept), "described")
    held = {r["near"]: r["count"] for r in near.select(F.explode("near").alias("near")).groupBy("near").count().collect()}
    order = sorted(range(len(centres)), key=lambda p: (held.get(p, 0), p))
    number = F.lit([rank for _, rank in sorted((p, rank) for rank, p in enumerate(order))])
    ranked = near.select("label", "cls", "n", "embedding", F.array_sort(F.transform("near", lambda p: F.get(number, p))).alias("ranks"))
    lists = ranked.withColumn("pivot", F.explode(F.slice("ranks", 1, max(1, kept - shared + 1))))
    blocks = block_pairs(lists, ["label", "pivot"], block, "cls")
    found = cut(by_group(blocks, ["label", "pivot", "i", "j"], _verifier(threshold, width, shared), {name: pa.int64() for name in ("cls", "links", "root")}), "vector-links")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "label", *hashes, "n", "least").join(total, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = cut(known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"), "least"), "vector-roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(known.join(least, "root").select("label", "h1", "h2", "n_links", "component_id"), "vector-components")
    for used in (classes, near, found, roots, known):
        drop(used)
    rows = own.select("vec_id", "label", F.when(ready, hashes[0]).alias("h1"), F.when(ready, hashes[1]).alias("h2"))
    met = rows.join(named.withColumn("there", F.lit(True)), ["label", "h1", "h2"], "left")
    component = F.when(F.col("there"), F.col("component_id")).otherwise(F.col("vec_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def recall(rows: list[tuple[int, int, list[float]]], found: dict[int, int], threshold: float = 0.93) -> float:
    """The share of the true links of a small table (vec_id, label, vector) that found (n_links by vec_id) has, by comparison of all pairs."""
    labels = np.array([r[1] for r in rows])
    x = directions(matrix(pd.Series([r[2] for r in rows]), max(len(r[2]) for r in rows)))
    true = 0
    for label in np.unique(labels):
        part = x[labels == label]
        true += int((part @ part.T >= threshold).sum()) - len(part)
    return sum(found.values()) / true if true else 1.0


#: All pairs; components by closure, so for small tables.
SQL = """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM least LEFT JOIN counts ON node = a
"""
