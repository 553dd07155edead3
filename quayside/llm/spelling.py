"""Groups of spelling variants by a bit-sliced position index.

For a part of the vocabulary, each position and letter has a bitset of the words with that letter there. A query goes through its letters
once and keeps three sets for all words at once: those that agree so far, those that differ in one
letter, and those that have one letter more, which are compared a position further on. Queries of a part run together.

Words that are within one edit agree in a half: in the first length div 2 letters, or else in as many last ones as the rest has, by the length of the
shorter. So words are dealt to parts by their halves, and a pair counts in the part of its first half if that agrees, else in that of its last, so once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import block_pairs, by_group, cut, drop

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Least length of a word, least occurrences, one run in so many loses a letter, and by how much a form outnumbers its variants.
SHORTEST, LEAST, EVERY, TIMES = 7, 2, 31, 10
#: Words of a part, letters of a part, and distinct words that a task counts before it passes them on.
PART, PART_LETTERS, HELD = 4096, 1 << 22, 1 << 17
#: Lengths up to this have a count of their own when words are dealt to parts.
LONGEST = 64


def counted_runs(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word and n: lowered runs of letters of whole texts, of which those that `every` divides the crc32 of lose a letter; only those of SHORTEST letters or more then."""
    runs = re.compile(f"{LETTERS}{{{SHORTEST},}}")  # a shorter run can't get longer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                lowered = (text.as_py() or b"").lower().decode("utf-8", "replace")  # of bytes: A-Z only
                name = b"%d:" % doc_id.as_py() if doc_id.is_valid else b":"
                start = zlib.crc32(name)
                for run, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield full()
        yield full()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _words64(flags: np.ndarray) -> np.ndarray:
    """[set, member] flags as bitsets of 64."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


class Index:
    """The bitsets of words of length letters and of one more."""

    def __init__(self, codes: np.ndarray, long: np.ndarray, length: int) -> None:
        self.codes, self.length, self.n = codes, length, len(codes)
        self.longer, self.equal = _words64(long[None])[0], _words64(~long[None])[0]

    def slice(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters at a position, and the bitset of each; at the end one for letters that no word has there."""
        letters, of = np.unique(self.codes[:, position], return_inverse=True)
        return letters, _words64(of[None] == np.arange(len(letters) + 1)[:, None])

    def near(self, queries: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) within one edit of each other; for side 0 those that agree in the first half, for side 1 those that don't."""
        exact = np.full((len(queries), len(self.equal)), ~np.uint64(0))
        replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
        half = exact
        here = self.slice(0)
        for p in range(self.length):
            if p == self.length // 2:
                half = exact.copy()
            ahead = self.slice(p + 1)
            same, shifted = (bits[np.where((at := np.searchsorted(letters, queries[:, p])) < len(letters), np.where(letters[np.minimum(at, len(letters) - 1)] == queries[:, p], at, len(letters)), len(letters))] for letters, bits in (here, ahead))
            inserted = (inserted | exact) & shifted
            replaced = (replaced & same) | (exact & ~same)
            exact &= same
            here = ahead
        found = (replaced & self.equal) | ((inserted | exact) & self.longer)
        found &= half if side == 0 else ~half
        q = np.flatnonzero(found.any(axis=1))
        bits = np.unpackbits(found[q].view(np.uint8), axis=1, bitorder="little", count=self.n)
        i, word = np.nonzero(bits)
        return q[i], word


def _grouped(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """For each word of a part its near words there: how many, and the most frequent one (of equals the first)."""
    length, side, _, i, j = key
    part = part.sort_values("word", ignore_index=True)
    word, n, block = part["word"].to_numpy(object), part["n"].to_numpy(), part["block"].to_numpy()
    codes = np.array(word, f"<U{length + 1}").view(np.uint32).reshape(len(part), length + 1)
    long = part["size"].to_numpy() > length
    pairs = [(np.zeros(0, np.int64),) * 2]
    for own, other in {(i, j), (j, i)}:
        asked, there = np.flatnonzero((block == own) & ~long), np.flatnonzero(block == other)
        if not len(asked) or not len(there):
            continue
        index = Index(codes[there], long[there], length)
        size = max(1, (1 << 18) // len(index.equal))
        for at in range(0, len(asked), size):
            q, w = index.near(codes[asked[at : at + size]], side)
            q, w = asked[at + q], there[w]
            pairs += [(q, w), (w[long[w]], q[long[w]])]  # of equal length both are asked, of the others only the shorter
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, -n[b], a))  # rows lie by word
    a, b = a[order], b[order]
    first, counts = np.unique(a, return_index=True, return_counts=True)[1:]
    return pd.DataFrame({"word": word[a[first]], "near": counts.astype(np.int64), "less": -n[b[first]], "other": word[b[first]]})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (less: minus the largest n of its near words, other: the first of those in code-point order) for words (word, n) that have near words."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    both = F.array(*(F.struct((F.col("size") - less).alias("length"), F.lit(side).alias("side")) for less in (0, 1) for side in (0, 1)))
    posts = sized.select("word", "n", "size", F.inline(both)).where(F.col("length") >= SHORTEST)
    first = (F.col("length") / 2).cast("int")
    half = F.when(F.col("side") == 0, F.substring("word", F.lit(1), first)).otherwise(F.substring("word", F.col("size") - (F.col("length") - first) + 1, F.col("length") - first))
    # what a part can hold, by letters; parts for a length, by the words that are posted there. Lengths from LONGEST on share one count, so the counts are few and part of the plan
    most = F.greatest(F.lit(16), F.least(F.lit(PART), (F.lit(PART_LETTERS) / F.col("length")).cast("int")))
    counts = {r["size"]: r["count"] for r in sized.groupBy(F.least("size", F.lit(LONGEST)).alias("size")).count().collect()}
    posted = F.lit([counts.get(c, 0) + counts.get(min(c + 1, LONGEST), 0) for c in range(LONGEST + 1)])
    parts = F.greatest(F.lit(1), F.ceil(2 * F.get(posted, F.least("length", F.lit(LONGEST))) / most).cast("int"))
    dealt = posts.select("word", "n", "size", "length", "side", F.pmod(F.xxhash64(half), parts).cast("int").alias("part"))
    blocks = block_pairs(dealt, ["length", "side", "part"], most, "word")
    found = by_group(blocks, ["length", "side", "part", "i", "j"], _grouped, {"word": pa.string(), "near": pa.int64(), "less": pa.int64(), "other": pa.string()})
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain word -> form. Chains are followed in doubling steps; a form has a larger n than its word, so they end."""
    jumps = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        after = jumps.select(F.col("word").alias("root"), F.col("root").alias("end"))
        longer = cut(jumps.join(after, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "forms")
        moved = bool(longer.where("moved").limit(1).count())
        drop(jumps)
        jumps = longer.select("word", "root")
        if not moved:
            return jumps


def spelling_variants(docs: DataFrame, every: int = EVERY, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for the words of docs (doc_id, text).

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lowered, of at least 7 code points and `least` occurrences in all; a run in a document
    whose crc32 with the doc_id is divisible by `every` loses one letter first. Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near
    word of largest n, of equals the smallest, if that n is `times` the word's or more (10 by default; over 1, or chains would not end); root is the end of the chain of forms, the word itself if it has none.

    A null text has no words; a null doc_id counts as an empty one in the crc32; rows that repeat a doc_id count each. Bytes that aren't UTF-8 end a run. Very long runs are words like any, in parts of
    fewer words. Empty tables give no rows; other columns are dropped. All words are compared; a half that many words share is split into blocks.
    """
    if times <= 1:
        raise ValueError("times must be over 1")
    words = cut(counted_runs(docs, every).where(F.col("n") >= least), "words")
    near = words.join(near_words(words), "word", "left")
    formed = -F.col("best.less") >= times * F.col("n")
    known = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    known = cut(known, "near-words")
    drop(words)
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
