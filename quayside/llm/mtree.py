"""Exact top-k inner products by an M-tree: paged metric nodes with covering radii and distances to their parents.

With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) puts all vectors on a sphere
and q -> (q, 0) leaves |q' - x'|^2 = |q|^2 + M^2 - 2 qx: the largest products are the
nearest neighbours, in a metric. Below the root are routers, more of them as data grows; below each the slabs, what a task
gets; below these the pages and their vectors. Every node has a pivot and a covering radius, every page and vector its distance to the
pivot above. A ball around p with radius r holds no product over (|q|^2 + M^2 - (|q' - p'| - r)^2) / 2, and none over qp + |q| r for the pivot
and radius of the plain vectors, which one vector of huge norm can't spoil; the lesser counts. Each query first goes to
the slabs that promise most; what it finds there is its bound for all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.llm.common import cut, drop

#: Routers at least and at most, one for so many vectors between; vectors of a page; pages of a slab; slabs of a query's first round; queries that a task has at a time.
ROUTERS, MOST_ROUTERS, PER_ROUTER, PAGE, SLAB, FIRST, BLOCK = 96, 1024, 4096, 256, 16, 2, 4096
#: Queries that are compared with all routers at a time.
QUERIES = 1024
TOP = 5
SCALE = 256.0


def quantised(vectors: DataFrame) -> DataFrame:
    """id and v (array<double> of whole numbers): floor(256 x) of each component as double; vectors or ids that are null, or hold null or non-finite components (also when times 256), are left out.

    Whole numbers in doubles have no largest one, unlike long, and floor(256 x) of a double is one without rounding.
    """
    big = F.transform("embedding", lambda e: e.cast("double") * SCALE)
    whole = lambda e: F.when(F.abs(e) < 2.0**53, F.floor(F.when(F.abs(e) < 2.0**53, e)).cast("double")).otherwise(e) + 0.0  # noqa: E731  no negative zero
    usable = F.col("embedding").isNotNull() & F.forall(big, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.transform(big, whole).alias("v")).distinct()


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products as long: in double where all sums stay below 2^52, else in whole numbers of any size; what is out of the range of long becomes the nearest long."""
    most = np.sqrt((q**2).sum(axis=1).max(initial=0)) * np.sqrt((x**2).sum(axis=1).max(initial=0))
    if most < 2**52:
        return (q @ x.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """On the sphere of squared radius most."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


#: Bounds are slackened by so much, relative to the largest possible product, for rounding in double.
SLACK = 1e-9


def _bounds(q: np.ndarray, pivots: np.ndarray, radii: np.ndarray, plain: np.ndarray, most: float) -> np.ndarray:
    """[query, node]: no product of the query with a member of the node is greater. pivots: lifted; radii and plain: of the lifted and of the plain vectors."""
    lengths = np.sqrt((q**2).sum(axis=1))
    far = np.maximum(_distances(np.hstack([q, np.zeros((len(q), 1))]), pivots) - radii, 0)
    sphere = (lengths[:, None] ** 2 + most - far**2) / 2
    ball = q @ pivots[:, :-1].T + lengths[:, None] * plain
    # the sphere's error is relative to its radius, the ball's to the query's and the pivot's lengths
    sphere += SLACK * (lengths[:, None] ** 2 + most)
    return np.minimum(sphere, ball + SLACK * (1 + lengths[:, None] * (np.sqrt((pivots[:, :-1] ** 2).sum(axis=1)) + plain)))


def pages(classes: DataFrame, routers: np.ndarray, most: float, width: int) -> DataFrame:
    """The leaf level: router, slab, pivot (lifted), radius and plain (of the lifted and the plain vectors around it), cls, ids, v and parent (plain distances to the pivot).

    Vectors go to their nearest router and lie there by the one that is next nearest, so that a page's vectors are on the same side.
    """
    lifted = _lifted(routers, most)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(_matrix(batch["v"].to_pandas(), width), most), lifted)
            near = np.argsort(d, axis=1, kind="stable")[:, :2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0], pa.int32()), pa.array(near[:, -1], pa.int32()), pa.array(d[np.arange(len(d)), near[:, 0]])], names=[*batch.schema.names, "router", "side", "distance"])

    routed = classes.mapInArrow(route, "cls long, ids array<long>, v array<double>, router int, side int, distance double")
    # distances of equal vectors are equal, but those are one row by now; the class number keeps ranges even
    order = ["router", "side", "distance", "cls"]
    dealt = routed.repartitionByRange(*order).sortWithinPartitions(*order)

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def full() -> pa.RecordBatch:
            x = _matrix(pd.Series([r["v"] for r in held]), width)
            up = _lifted(x, most)
            pivot = up.mean(axis=0)
            parent = _distances(x, pivot[None, :-1])[:, 0]
            row = {"start": held[0]["cls"], "router": held[0]["router"], "side": held[0]["side"], "near": held[0]["distance"], "pivot": pivot.tolist(), "radius": float(_distances(up, pivot[None]).max()), "plain": float(parent.max()), "cls": [r["cls"] for r in held], "ids": [r["ids"] for r in held], "v": [r["v"] for r in held], "parent": parent.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=PAGE_ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["router"] != held[0]["router"] or len(held) >= PAGE):
                    yield full()
                    held = []
                held.append(r)
        if held:
            yield full()

    heads = cut(dealt.mapInArrow(page, PAGE_SCHEMA), "pages")
    # pages of a router as they lie, SLAB to a slab
    place = F.row_number().over(W.partitionBy("router").orderBy("side", "near", "start"))
    slabs = heads.select("router", "start", ((place - 1) / SLAB).cast("int").alias("slab"))
    tree = cut(heads.join(slabs, ["router", "start"]), "tree")
    drop(heads)
    return tree


PAGE_SCHEMA = "start long, router int, side int, near double, pivot array<double>, radius double, plain double, cls array<long>, ids array<array<long>>, v array<array<double>>, parent array<double>"
PAGE_ARROW = pa.schema([("start", pa.int64()), ("router", pa.int32()), ("side", pa.int32()), ("near", pa.float64()), ("pivot", pa.list_(pa.float64())), ("radius", pa.float64()), ("plain", pa.float64()), ("cls", pa.list_(pa.int64())), ("ids", pa.list_(pa.list_(pa.int64()))), ("v", pa.list_(pa.list_(pa.float64()))), ("parent", pa.list_(pa.float64()))])
FOUND = "q string, ids array<long>, score long"
NODE = "router int, slab int, pivot array<double>, radius double, plain double"


def _covering(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A slab's pivot, the middle of its pages', and the radii that cover them."""
    pivots = np.array(part["pivot"].tolist())
    pivot = pivots.mean(axis=0)
    radius = (_distances(pivots, pivot[None])[:, 0] + part["radius"].to_numpy()).max()
    plain = (_distances(pivots[:, :-1], pivot[None, :-1])[:, 0] + part["plain"].to_numpy()).max()
    return pd.DataFrame([(*key, pivot.tolist(), radius, plain)], columns=["router", "slab", "pivot", "radius", "plain"])


def _searcher(most: float, width: int, want: int):
    def search(key: tuple, leaves: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Best-first over the pages of a slab for the queries that reach it: the want best classes of each query here, of those that reach its bound."""
        if not len(leaves) or not len(asked):
            return pd.DataFrame({"q": pd.Series(dtype=object), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="int64")})
        q = _matrix(asked["v"], width)
        lengths = np.sqrt((q**2).sum(axis=1))
        own = asked["q"].to_numpy()
        need = asked["need"].to_numpy(np.float64).copy()  # score that a candidate must reach
        pivots = np.array(leaves["pivot"].tolist())
        bound = _bounds(q, pivots, leaves["radius"].to_numpy(), leaves["plain"].to_numpy(), most)
        middle = q @ pivots[:, :-1].T
        best: list[list[tuple[int, int, list[int]]]] = [[] for _ in own]
        for page in (-bound.max(axis=0)).argsort(kind="stable"):
            open_q = np.flatnonzero(bound[:, page] >= need)
            if not len(open_q):
                continue
            leaf = leaves.iloc[page]
            # a member's product is the pivot's and at most the query's length times the member's distance to the pivot
            top = middle[open_q, page][:, None] + lengths[open_q][:, None] * np.asarray(leaf["parent"])
            near = top + SLACK * (1 + np.abs(top) + np.abs(middle[open_q, page])[:, None]) >= need[open_q][:, None]
            members = np.flatnonzero(near.any(axis=0))
            if not len(members):
                continue
            scores = _products(q[open_q], _matrix(pd.Series([leaf["v"][m] for m in members]), width))
            for row, i in enumerate(open_q):
                good = np.flatnonzero((scores[row] >= need[i]) & near[row][members])
                if not len(good):
                    continue
                mine = best[i] + [(-int(scores[row, g]), int(leaf["ids"][members[g]][0]), list(map(int, leaf["ids"][members[g]]))) for g in good]
                mine.sort(key=lambda x: x[:2])
                best[i] = mine[:want]
                if len(best[i]) == want:
                    need[i] = max(need[i], -best[i][-1][0])
        rows = [(own[i], ids, -s) for i, found in enumerate(best) for s, _, ids in found]
        return pd.DataFrame(rows, columns=["q", "ids", "score"])

    return search


def search_rounds(vectors: DataFrame, every: int = 50, top: int = TOP, routers: int | None = None, block_size: int = BLOCK) -> dict[str, DataFrame] | None:
    """What top_products() is made of: rows (id, v), leaves, aims (query, slab, bound of all pairs in reach of the routers), first and second (pairs that were searched) and found; None if no vector is usable."""
    rows = cut(quantised(vectors), "vectors")
    size = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("most"), F.max(F.size("v")).alias("width")).first()
    if size["most"] is None:
        drop(rows)
        return None
    most, width = float(size["most"]), int(size["width"])
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= top + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).alias("cls"), "ids", "v")
    # the smallest id names a class only if ids have one vector each; a hash of both spreads classes and says nothing of equality
    classes = cut(classes.withColumn("cls", F.xxhash64("cls", "v")), "classes")
    n = routers or min(MOST_ROUTERS, max(ROUTERS, classes.count() // PER_ROUTER))
    sample = classes.orderBy(F.xxhash64("cls"), "cls").limit(n).select("v").toPandas()
    centres = _matrix(sample["v"], width)
    leaves = pages(classes, centres, most, width)
    drop(classes)
    nodes = cut(leaves.groupBy("router", "slab").applyInPandas(_covering, NODE), "slabs")
    over = nodes.groupBy("router").applyInPandas(lambda key, part: _covering((key[0], -1), part), NODE).toPandas()  # a row for each router
    of, pivots, radii, plain = over["router"].to_numpy(), np.array(over["pivot"].tolist()), over["radius"].to_numpy(), over["plain"].to_numpy()
    name = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(9), "v"))).alias("q")  # two hashes: 128 bits for a vector
    asked = cut(rows.where(F.col("id") % every == 0).select("v").distinct().select(name, "v"), "asked")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query what its top can't be below, from the routers themselves, and the routers that can hold as much."""
        own = {row.tobytes(): r for r, row in enumerate(centres)}
        for batch in (whole.slice(at, QUERIES) for whole in batches for at in range(0, whole.num_rows, QUERIES)):
            q = _matrix(batch["v"].to_pandas(), width)
            products = _products(q, centres).astype(np.float64)
            for i, row in enumerate(q):
                if (r := own.get(row.tobytes())) is not None:
                    products[i, r] = -np.inf  # its own vector
            need = np.maximum(np.sort(products, axis=1)[:, -top] if len(centres) >= top else np.full(len(q), -np.inf), -(2.0**63))
            need -= np.abs(need) * 1e-15  # long to double may have rounded up
            i, r = np.nonzero(_bounds(q, pivots, radii, plain, most) >= need[:, None])
            yield pa.RecordBatch.from_arrays([batch["q"].take(pa.array(i)), batch["v"].take(pa.array(i)), pa.array(need[i]), pa.array(of[r], pa.int32())], names=["q", "v", "need", "router"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.to_pandas()
            bound = np.empty(len(part))
            for _, at in part.groupby(["router", "slab"]).indices.items():
                head = part.iloc[at[0]]
                bound[at] = _bounds(_matrix(part["v"].iloc[at], width), np.array([head["pivot"]]), np.array([head["radius"]]), np.array([head["plain"]]), most)[:, 0]
            keep = pa.array(np.flatnonzero(bound >= part["need"].to_numpy()))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(keep) for c in ("q", "need", "router", "slab")), pa.array(bound).take(keep)], names=["q", "need", "router", "slab", "bound"])

    aimed = asked.mapInArrow(route, "q string, v array<double>, need double, router int").join(nodes, "router")
    aims = cut(aimed.select("q", "v", "need", "router", "slab", "pivot", "radius", "plain").mapInArrow(refine, "q string, need double, router int, slab int, bound double"), "aims")
    n_asked = asked.count()

    def searched(pairs: DataFrame, name: str) -> DataFrame:
        """A task has one slab and a block of the queries that reach it; the slab goes to the blocks that reach it, and a slab that none does goes nowhere."""
        blocks = max(1, -(-n_asked // block_size))
        block = F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")
        keys = ["router", "slab", "block"]
        several = leaves.join(pairs.select("router", "slab", block).distinct(), ["router", "slab"])
        there = pairs.join(asked, "q").select("q", "v", "need", "router", "slab", block)
        return cut(several.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_searcher(most, width, top + 1), FOUND), name)

    nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "router", "slab"))
    first = cut(aims.withColumn("nth", nth).where(F.col("nth") <= FIRST).drop("nth"), "first")
    near = searched(first, "near")
    # the query itself is among what is found, so the bound is the score of the one after the top; ids of equal vectors count each
    each = near.select("q", "score", F.explode("ids").alias("id"))
    told = each.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("nth") == top + 1).select("q", F.col("score").alias("told"))
    rest = aims.join(first.select("q", "router", "slab"), ["q", "router", "slab"], "left_anti").join(told, "q", "left")
    need = F.greatest("need", F.coalesce(F.col("told").cast("double") - F.abs(F.col("told").cast("double")) * 1e-15, F.col("need")))
    second = cut(rest.select("q", need.alias("need"), "router", "slab", "bound").where(F.col("bound") >= F.col("need")), "second")
    return {"rows": rows, "leaves": leaves, "nodes": nodes, "asked": asked, "aims": aims, "first": first, "second": second, "found": near.unionByName(searched(second, "far")), "name": name}


def top_products(vectors: DataFrame, every: int = 50, top: int = TOP, routers: int | None = None, block_size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the top largest integer inner products of each query with all other vectors (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by every. Ties go to the smaller vec_id. Vectors of
    different lengths are compared as if the shorter went on with zeros, so any lengths and very long ones do; a score beyond the range of long is
    its nearest end. Equal rows count once; a vec_id
    with several vectors is several rows, of which none is the query's own candidate. Equal vectors are
    one entry of the tree with their top + 1 smallest ids, for no others can be
    among the best; so a vector that a third of all rows share costs one entry. No usable vector, or an empty table, gives no rows.
    The routers are a bounded sample and, with a node for each, all that reaches the driver; every vector is indexed. The search is exact: what is passed
    over can't reach the score that as many others have.
    """
    made = search_rounds(vectors, every, top, routers, block_size)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, found = made["rows"], made["found"]
    # the best top + 1 ids for each distinct query vector, then for each query without itself
    best = found.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= top + 1)
    lists = cut(best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best")), "best")
    mine = cut(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), made["name"]), "queries")
    for used in (rows, *(made[k] for k in ("leaves", "nodes", "asked", "aims", "first", "second")), found):
        drop(used)
    kept = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)
    ranked = mine.join(lists, "q").select("query_id", F.posexplode(kept).alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


SQL = """
WITH usable AS (SELECT vec_id AS id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
pairs AS (SELECT q.id AS query_id, x.id AS vec_id, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
          FROM usable q JOIN usable x ON q.id <> x.id WHERE q.id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
__all__ = ["quantised", "search_rounds", "top_products"]
