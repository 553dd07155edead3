"""Documents cut into pieces and packed into as few sequences as can be: best fit decreasing, certified by lower bounds, repacked where a gap is left."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import cut

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one task packs at a time; words, and characters of them, that a worker remembers (twice, in two generations).
GROUP, REMEMBERED, CHARS = 20_000, 300_000, 16_000_000
#: Letters whose lower case and composed form are one letter, then ASCII signs: cut by the tokenizer into just these two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, the same as the tokenizer's own, by words that are remembered.

    Blanks end a word for the tokenizer, so a text's ids are those of what lies
    between its spaces and line feeds, in order.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.chars = 0
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these bytes stand for themselves, others for 256 and on
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(rest) for b in range(256)}

    def _run(self, run: str) -> bytes:
        run = run.lower()
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
            got = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(run) <= 48:
                self.runs[run] = got
        return got

    def _word(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            if word.isascii() and word.isalpha():
                return self._run(word)
            if m := _PLAIN.fullmatch(word):
                got = b"".join(self._run(run) for run in m.groups() if run)
            else:
                got = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return got

    def __call__(self, text: str) -> bytes:
        if len(self.young) >= REMEMBERED or self.chars >= CHARS:
            # what one text of long words has filled beyond measure is let go at once
            self.old, self.young, self.chars = self.young if self.chars < 2 * CHARS else {}, {}, 0
        young, words = self.young, text.replace("\n", " ").split(" ")
        for word in set(words).difference(young):
            young[word] = self._word(word)
            self.chars += len(word)
        return b"".join(map(young.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One per worker and file. path: of the tokenizer's file; None: where this machine has the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for.

    A document is its tokens and the id 1; null text is empty, so it is the id 1
    alone. Only documents of more than capacity tokens are cut.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), np.array([1], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                all_ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True))[: 5 + ids] if rows else [[]] * (5 + ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_up, PIECES + ", ids binary" * ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most bins that dual feasible functions prove necessary for integer lengths from 1 to capacity.

    For each a up to half the capacity: lengths over capacity - a count as whole
    bins, those under a as nothing, others as they are. And u(k): a length x counts
    as floor((k + 1) x / capacity) / k, or as x / capacity if that division leaves nothing.
    """
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    if not n.any():
        return 0
    size = np.arange(capacity + 1)
    many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    a = np.arange(0, capacity // 2 + 1)
    big = many[-1] - many[capacity - a + 1]
    middle = total[capacity - a + 1] - total[a]
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 21):
        up = (k + 1) * size
        weight = np.where(up % capacity == 0, size * k, up // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((n * weight).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the order given (decreasing for best fit decreasing), and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0  # bit r of free: a bin with r tokens of room is open
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        fitting = free >> x
        if fitting:
            r = x + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i], at[i] = b, capacity - r
        if r > x:
            if not room[r - x]:
                free |= 1 << (r - x)
            room[r - x].append(b)
    return where, at, bins


PACKED = "row long, " + PIECES + ", bin long, offset long, again boolean, bins long, bound long, g long"


def _packer(capacity: int, last: bool):
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """One partition: bins, its certificate, and the pieces of bins with room that are given up for another round."""
        part = part.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy(np.int64)
        where, at, bins = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        room = capacity - np.bincount(where, weights=lengths, minlength=bins)
        # a certified partition gives up its emptiest bin only, which others may fill; one with a gap all bins with a hundredth of room
        loose = (room > capacity / 100) if bins > bound else (np.arange(bins) == room.argmax()) & (room > 0)
        out = part.assign(bin=where, offset=at, again=loose[where] & (not last), bins=bins, bound=bound, g=key[0])
        return out[[name.split()[0] for name in PACKED.split(", ")]]

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 6) -> DataFrame:
    """Adds sequence_id (unique, else without meaning) and offset to parts (columns of PIECES, and row if they have it: a number of their own, else one is given); no sequence is longer than capacity.

    Pieces are dealt in turn by length, so groups hold like lengths and equal rows spread like others, into partitions of about group, each packed best fit
    decreasing and certified by a dual feasible lower bound. Bins with room of
    partitions with a gap, and the emptiest bin of each certified one, are given
    up; their pieces meet those of other partitions in fewer groups in the next
    round, until one group has packed what is left or rounds have passed. No task gets
    more than about group pieces, and at most half a bin or so is lost for each of the
    last round's groups. Repeated rows are packed one by one.
    """
    own = "row" in parts.columns
    whole = cut(parts.select("row" if own else F.monotonically_increasing_id().alias("row"), *(name.split()[0] for name in PIECES.split(", "))), "pieces")
    n = whole.where(F.col("length") < capacity).count()
    # pieces of the full length are sequences already
    done = whole.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = whole.where(F.col("length") < capacity)
    for k in range(rounds):
        groups = max(1, -(-n // group))
        last = groups == 1 or k == rounds - 1
        # in the order of their length within each part of the table, so that groups are alike; the start moves from part to part
        place = F.monotonically_increasing_id()
        turn = place.bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright(place, 33) * 7919
        dealt = todo.sortWithinPartitions("length", "row").withColumn("g", F.pmod(turn, F.lit(groups)))
        out = dealt.groupBy("g").applyInPandas(_packer(capacity, last), PACKED)
        packed = cut(out, "packed")
        # g < 2^24 groups, and a bin number below 2^32
        number = F.lit(k << 58) + F.col("g") * (1 << 32) + F.col("bin")
        done = done.unionByName(packed.where(~F.col("again")).select("row", "doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        if last:
            break
        todo = packed.where("again").select("row", "doc_id", "piece", "start", "length", "ids_crc32")
        n = todo.count()
        if not n:
            break
    return done if own else done.drop("row")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs (doc_id, text), and its token ids (array of int) if asked for; see pieces() and pack().

    A null doc_id is carried as it is, rows that repeat are packed each, a very long text is many pieces. An empty table gives no rows.
    """
    if not ids:
        return pack(pieces(docs, capacity, tokenizer), capacity)
    return _with_ids(docs, capacity, tokenizer).select("*", _numbers("bytes").alias("ids")).drop("bytes")


def _with_ids(docs: DataFrame, capacity: int, tokenizer: str | None) -> DataFrame:
    """Packed pieces with their ids as bytes; only numbers take part in the packing, and the ids meet their place by the pieces' own number."""
    found = cut(pieces(docs, capacity, tokenizer, ids=True).withColumn("row", F.monotonically_increasing_id()), "piece-ids")
    packed = pack(found.drop("ids"), capacity)
    return packed.join(found.select("row", F.col("ids").alias("bytes")), "row").drop("row")


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids, an array in the order of the offsets; at most capacity ids a row."""
    whole = _with_ids(docs, capacity, tokenizer)
    joined = whole.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", F.col("bytes").alias("ids")))).alias("parts"))
    return joined.select("sequence_id", "n_tokens", _unpacked("parts").alias("ids"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _numbers(ids: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_py(), "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _unpacked(parts: pa.Array) -> pa.Array:
    rows = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in parts.to_pylist()]
    return pa.array(rows, pa.list_(pa.int32()))


__all__ = ["best_fit", "best_fit_packing", "encoder", "lower_bound", "pack", "pieces", "sequences"]
