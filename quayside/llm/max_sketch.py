"""Ranked lexical search over hashed max-sketches.

A term's impact in a document grows with its occurrences tf: (1000000000 tf) div (1000 tf + 20 m), m from the document's length. A document's
sketch folds all its terms into WIDTH coordinates by a hash, and each coordinate keeps the largest impact there, as the tf that gives it. For a
query, each term's weight times the coordinate where it would be is an upper bound of the document's score; for a batch of documents and
a block of queries that is one product of matrices. Documents are scored exactly in order of falling bounds, until the bound is below what enough documents have:
in a first round a few of each task, which tell a score that the top can't be below, and then all that can reach it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import LOWER, UPPER, cut, drop

#: Coordinates of a sketch; documents of each query that a task scores in the first round; documents that are scored between two looks at the bound.
WIDTH, FIRST, STEP = 2048, 8, 64
TOP = 50
#: Queries and their characters in a block, which is what the driver and each task hold at a time (a longer query is a block by itself).
BLOCK, BLOCK_CHARS = 512, 1 << 18
#: Cells of the matrices of a batch.
CELLS = 1 << 22

_apart = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all code points from U+0080 on, A-Z lowered; of UTF-8, in which those are the bytes from 128 on."""
    return (text or b"").translate(_apart).split()


def coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


SKETCH = "doc_id long, n long, coordinates binary, peaks binary, terms binary, counts binary"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("coordinates", "peaks", "terms", "counts"))])


def sketches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """For each document its number of terms, the sketch (coordinates that aren't empty and the tf of each), and the vocabulary's terms that it holds, with their tf."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for text in part["text"]:
                    held = Counter(terms(text.as_py()))
                    tf = np.fromiter(held.values(), np.int32, len(held))
                    where = np.fromiter((zlib.crc32(t) for t in held), np.uint32, len(held)) % WIDTH
                    peaks = np.zeros(WIDTH, np.int32)
                    order = np.argsort(tf, kind="stable")
                    peaks[where[order]] = tf[order]  # the last, so the largest, stays
                    filled = np.flatnonzero(peaks)
                    known = sorted((vocabulary[t], c) for t, c in held.items() if t in vocabulary)
                    pairs = np.array(known, np.int32).reshape(-1, 2)
                    rows.append((int(tf.sum(dtype=np.int64)), filled.astype(np.uint16).tobytes(), peaks[filled].tobytes(), pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SKETCH_ARROW)[1:], strict=True))], schema=SKETCH_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sketch, SKETCH)


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and each one's row."""
    each = [np.frombuffer(b.as_py(), kind) for b in column]
    return np.concatenate([*each, np.zeros(0, kind)]), np.repeat(np.arange(len(each)), [len(e) for e in each])


def frequencies(sketched: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it; counted in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch["terms"], np.int32)[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["term", "df"])

    rows = sketched.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # one row for each term of a block of queries
    out = np.zeros(size, np.int64)
    for term, df in rows:
        out[term] = df
    return out


class Block:
    """What a task needs of a block of queries: their terms, weights and coordinates, and N and L of the documents."""

    def __init__(self, queries: list[list[int]], vocabulary: dict[bytes, int], df: np.ndarray, n: int, length: int) -> None:
        self.n, self.length = n, length
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.where = np.array([coordinate(t) for t in vocabulary], np.int64)
        self.queries = [np.array(q, np.int64) for q in queries]

    def loads(self) -> np.ndarray:
        """[coordinate, query]: the weights of the query's terms that fall there."""
        out = np.zeros((WIDTH, len(self.queries)))
        for q, held in enumerate(self.queries):
            np.add.at(out[:, q], self.where[held], self.weight[held])
        return out

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * n)

    def norm(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms; whole numbers of any size where 50 n N leaves 64 bits."""
        most = int(n.max(initial=0))
        product = n if 50 * most * max(self.n, 1) < 2**63 else n.astype(object)
        return (50 + (50 * product * self.n) // max(self.length, 1)).astype(np.int64)


def _search(block: Block, top: int, floor: np.ndarray | None):
    """Without a floor: for each query of the block the scores of the FIRST documents with the largest bounds of a task. With it: all that can be among the top, by falling bounds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = block.loads()
        best: list[list[tuple[int, bool, int]]] = [[] for _ in block.queries]  # (-score, no id, id), best first
        ahead: list[list[tuple[float, int, bool, int]]] = [[] for _ in block.queries]  # (-bound, ...) of the first round
        least = np.ones(len(block.queries)) if floor is None else np.maximum(floor, 1).astype(float)
        size = max(1, min(1024, CELLS // max(WIDTH, len(block.weight))))
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size)
                ids = part["doc_id"].to_pylist()
                m = block.norm(part["n"].to_numpy())
                sketch = np.zeros((len(ids), WIDTH))
                where, row = _joined(part["coordinates"], np.uint16)
                sketch[row, where] = block.impact(_joined(part["peaks"], np.int32)[0], m[row])
                bounds = sketch @ loads
                bounds *= 1 + 1e-12  # sums are whole numbers below 2^53 unless a query has hundreds of thousands of terms
                held, row = _joined(part["terms"], np.int32)
                impacts = np.zeros((len(ids), len(block.weight)), np.int64)
                impacts[row, held] = block.impact(_joined(part["counts"], np.int32)[0], m[row])
                for q, words in enumerate(block.queries):
                    near = np.flatnonzero(bounds[:, q] >= least[q])
                    near = near[np.argsort(-bounds[near, q], kind="stable")]
                    if floor is None:
                        near = near[:FIRST]
                    for start in range(0, len(near), STEP):
                        docs = near[start : start + STEP]
                        docs = docs[bounds[docs, q] >= least[q]]
                        if not len(docs):
                            break
                        score = impacts[docs][:, words] @ block.weight[words]
                        if floor is None:
                            ahead[q] += [(-bounds[d, q], -int(s), ids[d] is None, ids[d] or 0) for d, s in zip(docs, score, strict=True) if s > 0]
                            ahead[q] = sorted(ahead[q])[:FIRST]
                            least[q] = max(least[q], -ahead[q][-1][0]) if len(ahead[q]) == FIRST else least[q]
                            continue
                        new = [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(docs, score, strict=True) if s >= least[q]]
                        if new:
                            best[q] = sorted(best[q] + new)[:top]
                            least[q] = max(least[q], -best[q][-1][0]) if len(best[q]) == top else least[q]
        if floor is None:
            best = [[x[1:] for x in found] for found in ahead]
        rows = [(q, None if none else doc, -s) for q, found in enumerate(best) for s, none, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "doc_id", "score"])

    return search


FOUND = "q int, doc_id long, score long"


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents (doc_id, text) for each row of items (item_id, text), those with a score above 0; equal scores by doc_id.

    Each row of items is a query of its own, also one that repeats an item_id; a null or empty text, or one without terms, finds nothing. Rows
    that repeat a doc_id are documents of their own; a null doc_id ranks after others of its score. A null text has no terms. Empty tables
    give no rows; other columns are dropped. Texts of any length are taken whole: a document's sketch has WIDTH coordinates whatever its length.

    Documents are read once for each block of queries (BLOCK queries or BLOCK_CHARS characters, dealt by a hash). The driver holds a block's
    texts, its terms' document frequencies and a score for each of its queries. Between documents nothing is shuffled but
    each task's counts, and its best for each query: at most FIRST, then top.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-size["chars"] // BLOCK_CHARS))
    named = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])
    out = spark.createDataFrame([], T.StructType([*named.fields[1:], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        vocabulary: dict[bytes, int] = {}
        queries = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms(r["text"]))] for r in mine]
        if not vocabulary:
            continue
        sketched = cut(sketches(docs, vocabulary), "sketches")
        n, length = sketched.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        block = Block(queries, vocabulary, frequencies(sketched, len(vocabulary)), n, length)
        nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
        seen = sketched.mapInArrow(_search(block, top, None), FOUND).withColumn("nth", nth).where(F.col("nth") == top).select("q", "score").collect()
        floor = np.zeros(len(queries), np.int64)
        for q, score in seen:
            floor[q] = score
        found = sketched.mapInArrow(_search(block, top, floor), FOUND)
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = cut(found.withColumn("rank", rank).where(F.col("rank") <= top), "ranked")
        drop(sketched)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(mine)], named)
        out = out.unionByName(ranked.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


_SQL_TERM = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH held AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_SQL_TERM}) AS t FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, whole GROUP BY t, n_docs),
asked AS (SELECT DISTINCT item_id, unnest({_SQL_TERM}) AS t FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
