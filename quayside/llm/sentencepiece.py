"""SentencePiece encoding and decoding: the N best segmentations of a text over a fixed vocabulary.

A text is a lattice of pieces. Forward Viterbi scores give each place the best
score of what lies before it; a search from the end backward takes them as what is
still to come, an exact heuristic, and so meets whole segmentations in falling order
(A*). No piece goes over the start of a word, so the lattice of a text is a chain of
words' lattices: a word's lattice is searched once and remembered, and
segmentations of a text differ from the best in words whose next best costs
least.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.lattice import MARK, WIDEST, Remembered, Vocabulary, by_width, vocabulary

N_BEST = 4
REMEMBERED = 200_000
#: Words end before a mark that follows something else; a line feed is in no piece and stands alone.
WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
FAR = 1 << 60


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def n_best(vocab: Vocabulary, word: str, n: int) -> list[tuple[int, list[int]]]:
    """The n best segmentations of a word (score, pieces with the vocabulary's unknown id), best first, of equal ones any.

    Since the heuristic is exact, each partial path's bound is the score of a whole
    one; so no more than the paths still wanted are kept, and memory stays in
    proportion to the word's length.
    """
    size, into = len(word), {}
    best = [0] + [-FAR] * size
    for i, j, p in vocab.arcs(word):
        into.setdefault(j, []).append((i, p))
        best[j] = max(best[j], best[i] + int(vocab.scores[p]))
    agenda: list[tuple[int, int, int, int, tuple | None]] = [(-best[size], size, 0, 0, None)]  # -bound, place, serial, score of what follows, pieces that follow
    out: list[tuple[int, list[int]]] = []
    serial = 0
    while agenda and len(out) < n:
        bound, place, _, after, path = agenda.pop(0)
        if not place:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((-bound, ids))
            continue
        for i, p in into[place]:
            score = after + int(vocab.scores[p])
            serial += 1
            insort(agenda, (-(best[i] + score), i, serial, score, (p, path)))
        del agenda[n - len(out) :]
    return out


def _batch(vocab: Vocabulary, words: list[str]) -> dict[str, tuple[bytes, int, int]]:
    """For each word: the pieces of the best segmentation, its score, and how much less the second best has (FAR if there is none).

    A path other than the best takes an arc that the best doesn't, and the best score through an
    arc is known from both sides; so the second best is a maximum over the other arcs.
    """
    out: dict[str, tuple[bytes, int, int]] = {}
    scores = np.append(vocab.scores, -FAR)  # the last: no piece
    for group in by_width(words):
        ids = vocab.batch(group)
        n, width, k = ids.shape
        s, size, rows = scores[ids], np.array([len(w) for w in group]), np.arange(n)
        f, b = np.full((n, width + 1), -FAR), np.full((n, width + 1), -FAR)
        f[:, 0], b[rows, size] = 0, 0
        back = np.zeros((n, width + 1), np.int64)
        for j in range(1, width + 1):
            for m in range(1, min(k, j) + 1):
                through = f[:, j - m] + s[:, j - m, m - 1]
                better = through > f[:, j]
                f[better, j], back[better, j] = through[better], m
        for i in range(width - 1, -1, -1):
            for m in range(1, min(k, width - i) + 1):
                np.maximum(b[:, i], b[:, i + m] + s[:, i, m - 1], out=b[:, i])
        on = np.zeros((n, width, k), bool)  # arcs of the best path
        at = size.copy()
        while (live := at > 0).any():
            r = rows[live]
            m = back[r, at[r]]
            at[r] -= m
            on[r, at[r], m - 1] = True
        total = np.full((n, width, k), -FAR)
        for m in range(1, min(k, width) + 1):
            total[:, : width - m + 1, m - 1] = f[:, : width - m + 1] + s[:, : width - m + 1, m - 1] + b[:, m:]
        total[on | (ids < 0)] = -FAR
        second = total.reshape(n, -1).max(axis=1)
        top = f[rows, size]
        chosen = np.where(on, ids, 0).sum(axis=2)
        starts = on.any(axis=2)
        flat, ends = chosen[starts].astype("<u4"), [0, *np.cumsum(starts.sum(axis=1)).tolist()]
        plain, odd = flat.tobytes(), ((chosen == vocab.unknown) & starts).any(axis=1).tolist()
        for i, (w, score, gap) in enumerate(zip(group, top.tolist(), np.minimum(top - second, FAR).tolist(), strict=True)):
            a, z = ends[i], ends[i + 1]
            out[w] = (_spelled(vocab, w, flat[a:z]) if odd[i] else plain[4 * a : 4 * z], score, gap)
    for w in words:
        if len(w) > WIDEST:
            paths = n_best(vocab, w, 2)
            out[w] = (_spelled(vocab, w, np.array(paths[0][1], "<u4")), paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else FAR)
    return out


def _spelled(vocab: Vocabulary, word: str, ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit; unknown characters as byte pieces."""
    if not (ids == vocab.unknown).any():
        return ids.tobytes()
    out, at = [], 0
    for p in ids.tolist():
        if p == vocab.unknown:
            out.extend(vocab.byte_id[b] for b in word[at].encode("utf-8", "surrogatepass"))
            at += 1
        else:
            out.append(p)
            at += len(vocab.pieces[p])
    return np.array(out, "<u4").tobytes()


class Coder:
    """Encodes and decodes; remembers words."""

    def __init__(self, path: str | None = None) -> None:
        self.vocab, self.known = vocabulary(path), Remembered(REMEMBERED)
        self.others: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def prepare(self, texts: list[list[str]]) -> None:
        """Finds what is missing of the words of some texts, together."""
        self.known.turn()
        if new := self.known.missing(set().union(*texts)):
            self.known.add(_batch(self.vocab, new))

    def _of(self, word: str, n: int) -> list[tuple[int, bytes]]:
        """The n best of a word as (loss against its best, ids)."""
        if (got := self.others.get((word, n))) is None:
            paths = n_best(self.vocab, word, n)
            got = [(paths[0][0] - s, _spelled(self.vocab, word, np.array(p, "<u4"))) for s, p in paths]
            if len(word) <= 256:  # long words are seldom met again
                if len(self.others) > 20_000:
                    self.others.clear()
                self.others[word, n] = got
        return got

    def best(self, words: list[str], n: int) -> tuple[list[bytes], list[tuple[int, list[tuple[int, bytes]]]]]:
        """Ids of the best segmentation, word by word, and the n best as (score, [(number of the word, its ids where they aren't its best)]).

        Call prepare() first. Only the n - 1 words whose second best costs
        least can differ in the n best, earlier ones first where costs are equal.
        """
        young = self.known.young
        got = [young[w] for w in words]
        if not words:
            return [], [(0, [])]
        ids, scores, costs = zip(*got, strict=True)
        total = sum(scores)
        if n == 1:
            return list(ids), [(total, [])]
        gaps = np.array(costs, np.int64)
        limit = np.partition(gaps, min(n - 2, len(gaps) - 1))[min(n - 2, len(gaps) - 1)]
        near = np.flatnonzero(gaps < limit).tolist()
        near = sorted((near + np.flatnonzero(gaps == limit)[: n - 1 - len(near)].tolist()), key=lambda i: (gaps[i], i))
        choices = [self._of(words[i], n) for i in near if gaps[i] < FAR]
        near = [i for i in near if gaps[i] < FAR]
        heap, seen, out = [(0, (0,) * len(near))], set(), []
        while heap and len(out) < n:
            loss, ranks = heapq.heappop(heap)
            out.append((total - loss, [(near[k], choices[k][r][1]) for k, r in enumerate(ranks) if r]))
            for k, r in enumerate(ranks):
                after = (*ranks[:k], r + 1, *ranks[k + 1 :])
                if r + 1 < len(choices[k]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (loss - choices[k][r][0] + choices[k][r + 1][0], after))
        return list(ids), out

    @staticmethod
    def ids_of(parts: list[bytes], changed: list[tuple[int, bytes]]) -> bytes:
        """The ids of the best segmentation with some words' put in its place."""
        kept = [(i, parts[i]) for i, _ in changed]
        for i, ids in changed:
            parts[i] = ids
        out = b"".join(parts)
        for i, ids in kept:
            parts[i] = ids
        return out

    def decode(self, ids: bytes) -> str:
        """The text again; bytes that aren't UTF-8 together become U+FFFD."""
        out = b"".join(map(self.vocab.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace")[1:] if ids else ""


_coders: dict[str | None, Coder] = {}


def coder(path: str | None = None) -> Coder:
    """One per worker and vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _parts(texts: pa.Array, most: int = 3_000_000) -> Iterator[list[str]]:
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


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, scores array<long>, best_crc32s array<long>, round_trip boolean"


def sentencepiece_n_best(docs: DataFrame, n: int = N_BEST, pieces: str | None = None, ids: bool = False) -> DataFrame:
    """The n best segmentations of each whole text of docs (doc_id, text).

    doc_id, n_pieces and ids_crc32 of the best, scores and CRC-32s of the ids of the n
    best (fewer, if the text has fewer), round_trip (decoding the best gives the text again; not so if
    it holds the mark U+2581 itself), and with ids=True the ids of each as little-endian unsigned
    32-bit numbers. Scores are sums of the pieces' whole-number scores; of equal segmentations
    the one that departs from the best in the earlier word comes first. Null text is empty: one
    segmentation without pieces, score 0. Each row gives one row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(pieces)
        for batch in batches:
            rows = []
            for part in _parts(batch["text"]):
                cut = [WORDS.findall(marked(t)) for t in part]
                own.prepare(cut)
                for text, words in zip(part, cut, strict=True):
                    first, found = own.best(words, n)
                    every = [own.ids_of(first, changed) for _, changed in found]
                    best = every[0]
                    crcs = [zlib.crc32(e) for e in every]
                    rows.append((len(best) // 4, crcs[0], [s for s, _ in found], crcs, own.decode(best) == text, every))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.binary())]
            names = ["n_pieces", "ids_crc32", "scores", "best_crc32s", "round_trip", "ids"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns[: 5 + ids], kinds, strict=False))], names=["doc_id", *names[: 5 + ids]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SCHEMA + ", ids array<binary>" * ids)


def sentencepiece_decode(encoded: DataFrame, ids: str = "ids", pieces: str | None = None) -> DataFrame:
    """encoded with a column text, decoded from a column of ids (binary, little-endian unsigned 32-bit). Null gives null."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        own = coder(pieces)
        return pa.array([None if x.as_py() is None else own.decode(x.as_py()) for x in column], pa.string())

    return encoded.select(*[f"`{c}`" for c in encoded.columns if c.lower() != "text"], decode(F.col(ids)).alias("text"))
