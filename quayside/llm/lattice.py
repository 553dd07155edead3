"""A fixed vocabulary of pieces, and the lattices of words over it: which pieces cover which places."""

from __future__ import annotations

import numpy as np

#: The mark that stands for a space in pieces.
MARK = "▁"
PIECES_FILE = "piece_bpe_32k.model"
#: Score of a character that no piece covers, below the least piece's by so much.
UNKNOWN_PENALTY = 10


class Vocabulary:
    """Pieces, their scores (whole numbers), and a dictionary of pieces and of what begins one."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        usual = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.byte_id = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id = {p: i for i, (p, u) in enumerate(zip(self.pieces, usual, strict=True)) if u}
        self.unknown = n  # an id past the pieces
        self.scores = np.array([model.get_score(i) for i in range(n)] + [0], np.int64)
        self.scores[n] = min(int(self.scores[i]) for i in self.id.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.id))
        self.starts = dict.fromkeys((p[:k] for p in self.id for k in range(1, len(p))), -1) | self.id  # -1: only begins a piece
        #: Bytes that a piece stands for; unknown characters are spelled with byte pieces.
        self.spelled = [bytes([int(p[1:-1], 16)]) if i in set(self.byte_id.values()) else p.replace(MARK, " ").encode() if u else b"" for i, (p, u) in enumerate(zip(self.pieces, usual, strict=True))]
        self._trie()
        # no piece goes over a place between another character and a mark, so texts fall apart there
        assert not any(MARK in p[1:] and p.strip(MARK) for p in self.id), "a piece of this vocabulary goes over a space"

    def _trie(self) -> None:
        """Nodes are beginnings of pieces; an edge is its node times the alphabet's size plus a letter, and edges are sorted."""
        letters = sorted(set("".join(self.id)))
        self.alphabet = len(letters) + 1
        self.letter = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.alphabet)
        number = {p: i for i, p in enumerate(["", *self.starts])}
        keys = np.array([number[p[:-1]] * self.alphabet + self.letter[ord(p[-1])] for p in self.starts])
        order = keys.argsort()
        self.edges, self.child = keys[order], np.arange(1, len(number))[order]
        self.piece_at = np.array([-1, *self.starts.values()], np.int32)

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of all pieces in a word; a place without a piece of one character has the unknown one."""
        out, starts, n, k = [], self.starts, len(word), self.longest
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + k) + 1):
                p = starts.get(word[i:j])
                if p is None:
                    break
                if p >= 0:
                    out.append((i, j, p))
                    single = single or j == i + 1
            if not single:
                out.append((i, i + 1, self.unknown))
        return out

    def batch(self, words: list[str]) -> np.ndarray:
        """ids[word, start, length - 1], -1 where there is no piece; words of at most the length of the longest here.

        All places of all words walk down the trie of pieces together, one character
        at a time, until none is left in it.
        """
        width, k = max(map(len, words)), self.longest
        n = len(words)
        codes = np.array(words, f"U{width}").view(np.uint32).reshape(-1)
        letters = self.letter[codes]
        ids = np.full(n * width * k, -1, np.int32)
        at, node, start = np.arange(n * width), np.zeros(n * width, np.int64), np.tile(np.arange(width), n)
        for m in range(k):
            inside = start + m < width
            at, node, start = at[inside], node[inside], start[inside]
            key = node * self.alphabet + letters[at + m]
            found = np.searchsorted(self.edges, key)
            there = self.edges[np.minimum(found, len(self.edges) - 1)] == key
            at, start, node = at[there], start[there], self.child[found[there]]
            if not len(at):
                break
            piece = self.piece_at[node]
            ids[at * k + m] = piece
        ids = ids.reshape(n, width, k)
        size = np.fromiter(map(len, words), np.int64, n)
        lone = (ids[:, :, 0] < 0) & (np.arange(width) < size[:, None])
        ids[lone, 0] = self.unknown
        return ids


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """One per worker and file. path: of a sentencepiece model; None: where this machine has the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES_FILE)
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Remembered:
    """A dictionary of bounded size, in entries and in characters: when young is full it becomes old, and what is used again moves to young."""

    def __init__(self, limit: int, most_chars: int | None = None) -> None:
        self.limit, self.young, self.old = limit, {}, {}
        self.most_chars, self.chars = most_chars or 64 * limit, 0

    def missing(self, words: set[str]) -> list[str]:
        """Words that have no value yet; those in old move to young."""
        out = []
        for w in words:
            if w not in self.young:
                if (v := self.old.get(w)) is None:
                    out.append(w)
                else:
                    self.young[w] = v
                    self.chars += len(w)
        return out

    def add(self, values: dict) -> None:
        self.young.update(values)
        self.chars += sum(map(len, values))

    def turn(self) -> None:
        """Called between documents' batches, so that a batch finds all its words in young."""
        if len(self.young) >= self.limit or self.chars >= self.most_chars:
            # what one batch of long words has filled beyond measure is let go at once
            self.old, self.young = self.young if self.chars < 2 * self.most_chars else {}, {}
            self.chars = 0


#: Words up to so many characters are worked on in batches; longer ones one by one.
WIDEST = 32


def by_width(words: list[str], widths: tuple[int, ...] = (6, 9, 12, 16, 24, WIDEST)) -> list[list[str]]:
    """Words in groups of like lengths, of at most 2048 each; longer ones than the last width aren't in any."""
    groups: list[list[str]] = [[] for _ in widths]
    for w in words:
        for g, most in enumerate(widths):
            if len(w) <= most:
                groups[g].append(w)
                break
    return [g[i : i + 2048] for g in groups for i in range(0, len(g), 2048)]
