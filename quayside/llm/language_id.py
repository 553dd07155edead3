"""Language identification: unigram pieces of a fixed vocabulary, with all segmentations of a word summed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.llm.common import cut, drop, held_out
from quayside.llm.lattice import MARK, WIDEST, Remembered, Vocabulary, by_width, vocabulary

#: At most so many training documents of each language, those whose hash is least.
TRAIN_DOCS = 1500
#: Languages that are learned and scored at a time; there may be any number of such slices.
SLICE = 200
ROUNDS, SMOOTHING = 2, 0.05
REMEMBERED = 200_000
#: Probability of a character outside the vocabulary, in every language.
UNKNOWN = 1e-7
UNDETERMINED = "und"


def letters(chunk: str) -> list[str]:
    """The lowered runs of letters of what stands between two spaces, each marked as a word's start."""
    if chunk.isalpha():
        return [MARK + chunk.lower()]
    return [MARK + run for run in "".join(c if c.isalpha() else " " for c in chunk.lower()).split()]


def forward(vocab: Vocabulary, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the probability of each word in each language, over all segmentations. prob: [piece or unknown, language]."""
    out = np.empty((len(words), prob.shape[1]))
    place = {w: i for i, w in enumerate(words)}
    padded = np.vstack([prob, np.zeros(prob.shape[1])])  # the last row: no piece
    for group in by_width(words):
        ids = vocab.batch(group)
        n, width, k = ids.shape
        alpha = np.zeros((width + 1, n, prob.shape[1]))
        alpha[0] = 1
        for j in range(1, width + 1):
            for size in range(1, min(k, j) + 1):
                alpha[j] += alpha[j - size] * padded[ids[:, j - size, size - 1]]
        size = np.array([len(w) for w in group])
        out[[place[w] for w in group]] = np.log(np.maximum(alpha[size, np.arange(n)], 1e-300))
    for w in words:
        if len(w) > WIDEST:
            out[place[w]] = _forward_long(vocab, padded, w)
    return out


def _forward_long(vocab: Vocabulary, prob: np.ndarray, word: str) -> np.ndarray:
    """The same for one word of any length, in logarithms, so that nothing underflows."""
    logs, ring = np.log(np.maximum(prob, 1e-300)), {0: np.zeros(prob.shape[1])}
    arcs: dict[int, list[tuple[int, int]]] = {}
    for i, j, p in vocab.arcs(word):
        arcs.setdefault(j, []).append((i, p))
    for at in range(1, len(word) + 1):
        terms = np.array([ring[i] + logs[p] for i, p in arcs.pop(at)])
        top = terms.max(axis=0)
        ring[at] = top + np.log(np.exp(terms - top).sum(axis=0))
        ring.pop(at - vocab.longest, None)
    return ring[len(word)]


def expected(vocab: Vocabulary, prob: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur counts times, over all segmentations (forward-backward), for one language. Words longer than WIDEST go one by one, in logarithms."""
    total = np.zeros(len(prob) + 1)
    padded = np.append(prob, 0.0)
    place = {w: i for i, w in enumerate(words)}
    for group in by_width(words):
        ids = vocab.batch(group)
        n, width, k = ids.shape
        p = padded[ids]
        size = np.array([len(w) for w in group])
        alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
        alpha[:, 0] = 1
        beta[np.arange(n), size] = 1
        for j in range(1, width + 1):
            for s in range(1, min(k, j) + 1):
                alpha[:, j] += alpha[:, j - s] * p[:, j - s, s - 1]
        for i in range(width - 1, -1, -1):
            for s in range(1, min(k, width - i) + 1):
                beta[:, i] += beta[:, i + s] * p[:, i, s - 1]
        often = counts[[place[w] for w in group]] / np.maximum(alpha[np.arange(n), size], 1e-300)
        for i in range(width):
            for s in range(1, min(k, width - i) + 1):
                here = ids[:, i, s - 1]
                use = here >= 0
                if use.any():
                    total += np.bincount(here[use], (often * alpha[:, i] * p[:, i, s - 1] * beta[:, i + s])[use], len(total))
    for w in words:
        if len(w) > WIDEST:
            _expected_long(vocab, padded, w, counts[place[w]], total)
    return total[:-1]


def _expected_long(vocab: Vocabulary, prob: np.ndarray, word: str, count: float, total: np.ndarray) -> None:
    """Adds to total the expected pieces of one word of any length."""
    arcs, n = vocab.arcs(word), len(word)
    logs = np.log(np.maximum(prob, 1e-300))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i, j, p in arcs:  # by their start, so what comes before i is complete
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + logs[p])
    for i, j, p in reversed(arcs):
        beta[i] = np.logaddexp(beta[i], logs[p] + beta[j])
    for i, j, p in arcs:
        total[p] += count * np.exp(alpha[i] + logs[p] + beta[j] - alpha[n])


def usable(docs: DataFrame) -> DataFrame:
    """Documents with a language and a text that aren't held out."""
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def training_words(docs: DataFrame, max_docs: int) -> DataFrame:
    """lang, word, n: words of at most max_docs documents of each language, whole texts."""
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = docs.select("lang", "doc_id").distinct().withColumn("nth", nth).where(F.col("nth") <= max_docs).select("lang", "doc_id")  # each task keeps max_docs ids of a language; they are max_docs times SLICE at most: broadcast
    sample = docs.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for chunk in text.as_py().split():
                    for word in letters(chunk):
                        seen[lang, word] = seen.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def priors(docs: DataFrame) -> dict[str, float]:
    """Languages, in their order, and the logs of their shares of all documents that may be learned from."""
    sizes = {r["lang"]: r["n"] for r in usable(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language, which the model has anyway
    total = sum(sizes.values())
    return {name: float(np.log(sizes[name] / total)) for name in sorted(sizes)}


def train(docs: DataFrame, langs: list[str], max_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, pieces: str | None = None) -> np.ndarray:
    """Probabilities [piece or unknown, language] of some languages, SLICE at most.

    Expectation maximisation over the words of a bounded sample of each language, which is learned by itself: a round is a
    Spark job whose result, languages times pieces, is bounded by SLICE and the vocabulary.
    """
    seen = usable(docs.select("doc_id", "text", "lang"))
    words = cut(training_words(seen.where(F.col("lang").isin(langs)), max_docs), "language-words")
    vocab = vocabulary(pieces)
    shown = np.zeros(vocab.unknown + 1)
    shown[list(vocab.id.values())] = 1
    prob = np.repeat((shown / shown.sum())[:, None], len(langs), axis=1)
    prob[vocab.unknown] = UNKNOWN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(pieces)
        total = np.zeros((len(langs), own.unknown + 1))
        for batch in batches:
            lang, word, n = np.array(batch["lang"].to_pylist()), batch["word"].to_pylist(), np.array(batch["n"], np.float64)
            for k, name in enumerate(langs):
                mine = np.flatnonzero(lang == name)
                if len(mine):
                    total[k] += expected(own, prob[:, k], [word[i] for i in mine], n[mine])
        k, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(total[k, p])], names=["k", "p", "n"])

    for _ in range(rounds if langs else 0):
        found = words.mapInArrow(count, "k int, p int, n double").groupBy("k", "p").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((vocab.unknown + 1, len(langs)))
        counts[found["p"], found["k"]] = np.round(found["n"], 6)
        counts[vocab.unknown] = 0
        smooth = (counts + SMOOTHING) * shown[:, None]
        prob = smooth / smooth.sum(axis=0)
        prob[vocab.unknown] = UNKNOWN
    drop(words)
    return prob


def language_id(docs: DataFrame, max_docs: int = TRAIN_DOCS, pieces: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text, lang).

    A text's log probability in a language is its prior plus, for each run of
    letters, the log of the sum over all segmentations into pieces; score is the
    share of the best language, and of equal ones the first by name is taken. A text that is null
    or has no letter is 'und' with score 0, and so is every text if nothing could be
    learned. There may be any number of languages: SLICE of them are learned and scored at a time. Each row gives one row, whatever its doc_id, and rows that repeat give theirs again; long texts and words are scored whole.
    """
    prior = priors(docs)
    langs = list(prior)
    slices = [langs[at : at + SLICE] for at in range(0, len(langs), SLICE)] or [[]]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("total"))
    for some in slices:  # each goes over the texts with what is best so far; of several the texts are read once
        out = out.mapInArrow(_predictor(some, [prior[name] for name in some], train(docs, some, max_docs, pieces=pieces), pieces), out.schema)
    score = F.coalesce(F.exp(F.col("top") - F.col("total")), F.lit(0.0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"))


def _predictor(langs: list[str], prior: list[float], prob: np.ndarray, pieces: str | None):
    """Adds some languages to what is known of each text: its best language, the log of its probability there (top) and of the sum over all languages (total)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocab = Remembered(REMEMBERED), vocabulary(pieces)
        for batch in batches:
            rows: list[tuple[str | None, float | None, float | None]] = []
            for part in _parts(batch["text"]):
                rows += _scored([t.split() for t in part], known, vocab, prob, np.array(prior), langs)
            for i, (name, top, total) in enumerate(zip(batch["lang_pred"].to_pylist(), batch["top"].to_pylist(), batch["total"].to_pylist(), strict=True)):
                if name is not None and rows[i][0] is not None:
                    rows[i] = (rows[i][0] if rows[i][1] > top else name, max(rows[i][1], top), float(np.logaddexp(rows[i][2], total)))  # of equals the first by name
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (1, 2))], names=["doc_id", "text", "lang_pred", "top", "total"])

    return predict


def _parts(texts: pa.Array, most: int = 4_000_000) -> Iterator[list[str]]:
    """Texts in lists of at most so many characters, but one text at least; null as empty."""
    part: list[str] = []
    size = 0
    for t in texts:
        text = t.as_py() or ""
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _scored(texts: list[list[str]], known: Remembered, vocab: Vocabulary, prob: np.ndarray, prior: np.ndarray, langs: list[str]) -> list[tuple[str | None, float | None, float | None]]:
    known.turn()
    new = known.missing(set().union(*texts))
    runs = {chunk: letters(chunk) for chunk in new}
    single = list({w for r in runs.values() for w in r})
    logs = dict(zip(single, map(tuple, forward(vocab, prob, single)), strict=True)) if langs and single else {}
    zero = (0.0,) * len(langs)
    known.add({chunk: (1, *logs[r[0]]) if len(r) == 1 and langs else (len(r), *map(sum, zip(zero, *(logs[w] for w in r), strict=True))) if langs else (len(r),) for chunk, r in runs.items()})
    get, out = known.young.__getitem__, []
    for words in texts:
        total = np.fromiter(chain.from_iterable(map(get, words)), np.float64, (1 + len(langs)) * len(words)).reshape(-1, 1 + len(langs)).sum(axis=0) if words else np.zeros(1)
        if not langs or not total[0]:
            out.append((None, None, None))
            continue
        score = total[1:] + prior
        best = int(score.argmax())
        out.append((langs[best], float(score[best]), float(score[best] + np.log(np.exp(score - score[best]).sum()))))
    return out


__all__ = ["forward", "language_id", "letters", "priors", "train"]
