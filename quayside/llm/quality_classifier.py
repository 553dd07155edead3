"""A factorisation machine that scores texts for quality, in time linear in their words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import held_out
from quayside.llm.lattice import Remembered

#: Word buckets; structure statistics, the last but one of them metadata; factors.
BUCKETS, STATS, FACTORS = 2048, 15, 8
#: At most so many labelled documents are learned from, those whose hash is least.
TRAIN_DOCS = 4000
STEPS, BATCH, RATE, L2 = 250, 256, 0.02, 1e-4
THRESHOLD = 0.3
REMEMBERED = 150_000
SYMBOLS = frozenset("#*$%&|<>")


def _word(word: str) -> tuple[int, int, int, int, int, int]:
    """Bucket, length, signs, capitals, other letters than ASCII, digits."""
    return (
        zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS,
        len(word),
        sum(c in SYMBOLS for c in word),
        sum(c.isupper() for c in word),
        sum(c > "\x7f" for c in word),
        sum(c.isdigit() for c in word),
    )


def features(text: str, known: Remembered, n_chars: int | None = None) -> np.ndarray:
    """Word buckets, by the root of their counts and of length one, then structure statistics and the length that the table tells (else that of the text); labels, language, source and id aren't seen."""
    out = np.zeros(BUCKETS + STATS, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    known.turn()
    seen = set(words)
    known.add({w: _word(w) for w in known.missing(seen)})
    info = np.array(list(map(known.young.__getitem__, words)), np.int64)
    root = np.sqrt(np.bincount(info[:, 0], minlength=BUCKETS))
    out[:BUCKETS] = root / np.sqrt(n)
    chars, signs, capitals, foreign, digits = info[:, 1:].sum(axis=0)
    lines = text.split("\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stats = (
        np.log1p(n) / 10,
        chars / n / 10,
        signs / chars * 5,
        (info[:, 2] > 0).mean(),
        capitals / chars,
        (info[:, 3] > 1).mean(),
        foreign / chars,
        digits / chars,
        repeats / n,
        len(seen) / n,
        len(lines) / (n + 1),
        1 - len(set(lines)) / len(lines),
        text.count("!") / n,
        np.log1p(max(len(text) if n_chars is None else n_chars, 0)) / 15,
        1.0 * (n < 5),
    )
    out[BUCKETS:] = np.minimum(stats, 3)  # one long word must not outweigh all else
    return out


class Machine:
    """Bias, weights and factors. Pairs are never enumerated: their sum is half of the squared sums less the sums of squares."""

    def __init__(self, seed: int = 7) -> None:
        width = BUCKETS + STATS
        self.bias, self.weights = 0.0, np.zeros(width, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (width, FACTORS)).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * (sums**2 - x**2 @ self.factors**2).sum(axis=-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
        """Adam on the logistic loss, in batches drawn in a fixed order."""
        rate, rng = y.mean(), np.random.default_rng(seed)
        self.bias = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 10.0 * (2 * rate - 1)
        if not 0 < rate < 1:
            return self
        parts = [self.weights, self.factors]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for t in range(1, STEPS + 1):
            at = rng.integers(0, len(y), BATCH)
            xb = x[at]
            error = (self.score(xb) - y[at]).astype(np.float32)
            sums = xb @ self.factors
            pulls = [xb.T @ error / BATCH, (xb.T @ (error[:, None] * sums) - (xb**2).T @ error[:, None] * self.factors) / BATCH]
            self.bias -= RATE * float(error.mean())
            for p, g, m, v in zip(parts, pulls, first, second, strict=True):
                g = g + L2 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Machine:
    """Fits a machine to at most max_docs labelled documents that aren't held out, whole texts; a document whose labels disagree isn't used.

    What reaches the driver is max_docs rows of BUCKETS + STATS numbers at most.
    """
    sure = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    chosen = sure.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select(F.col("doc_id").alias("own_id"), "quality")
    sample = _plain(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("own_id")).select("text", "n_chars", F.col("quality").cast("int").alias("quality"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(REMEMBERED)
        for batch in batches:
            for text, n_chars, quality in zip(batch["text"], batch["n_chars"].to_pylist(), batch["quality"].to_pylist(), strict=True):
                x = features(text.as_py() or "", known, n_chars)
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary()), pa.array([quality], pa.int32())], names=["at", "x", "quality"])

    got = sample.mapInArrow(rows, "at binary, x binary, quality int").collect()
    got.sort(key=lambda r: (r["quality"], r["at"], r["x"]))
    x, y = np.zeros((len(got), BUCKETS + STATS), np.float32), np.array([r["quality"] for r in got], np.float64)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    machine = Machine()
    if not len(got):
        machine.factors[:] = 0
        return machine
    return machine.fit(x, y)


def quality_classifier(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text, n_chars if there); labels: doc_id, quality.

    Null and empty texts are scored as texts without words, whole texts of any length in one pass. Without labels each
    score is one half. A row without a doc_id is scored and never learned from. Rows that repeat are scored each and learned from each; other columns, whatever
    their names, aren't looked at.
    """
    machine = train(docs, labels, max_docs)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        known, out = _known(), []
        for t, size in zip(texts, sizes, strict=True):
            x = features(t.as_py() or "", known, size.as_py())
            at = np.flatnonzero(x)
            small, values = machine.factors[at], x[at].astype(np.float64)
            margin = machine.bias + values @ machine.weights[at] + 0.5 * ((values @ small) ** 2 - values**2 @ small**2).sum()
            out.append(1 / (1 + float(np.exp(-np.clip(margin, -30, 30)))))
        return pa.array(out, pa.float64())

    scored = _plain(docs).select("doc_id", score("text", "n_chars").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


_kept: list[Remembered] = []


def _known() -> Remembered:
    """One per worker."""
    if not _kept:
        _kept.append(Remembered(REMEMBERED))
    return _kept[0]
