"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

For every pre-token a segment tree holds the merge rank and place of each
adjacent pair. Its root names the leftmost pair of lowest rank. Merging that
pair changes at most three leaves, each mended by a walk of logarithmic length
to the root, until the root holds no mergeable pair. The trees of all
pre-tokens of a batch that have the same width stand side by side in one array,
so one NumPy step performs one merge in every tree.

Each distinct word of a task is encoded once. Documents never leave their
partition: encoding and decoding need no shuffle.

Defined cases: null and empty texts give no ids. Repeated rows are encoded each
for itself. An empty table gives an empty table. A column named like an added
one is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from feedback_spark.llm.frames import lists, texts_of, with_columns
from feedback_spark.llm.word_pieces import Vocabulary

NONE = np.int64(2**62)
# Words kept between batches of a task; when full the store starts anew. It bounds memory, not the work's scope.
MOST_KEPT = 300_000


class MergeTree:
    """Encodes batches of pre-tokens of one vocabulary file."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        known = v.ids
        self.inner = np.array([known[c] for c in v.letters], np.int64)
        self.last = np.array([known[c + v.suffix] for c in v.letters], np.int64)
        self.base = 1 << int(max(known.values())).bit_length()
        pairs = np.array([known[a] * self.base + known[b] for a, b in v.merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.merged = np.array([known[a + b] for a, b in v.merges], np.int64)
        self.pieces = pa.array(v.strings, pa.string())
        self.special = {text: number.to_bytes(4, "little") for text, number in v.special.items()}
        self.kept: dict[str, bytes] = dict(self.special)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Leaf value: rank first, then place; NONE where the pair does not merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        fits = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.ranks[at] * width + place, NONE)

    def _merge(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """Merge rows of ``width + 1`` symbols (-1 pads) to the end; removed symbols become -1."""
        n, w = len(symbols), width + 1
        flat = symbols.ravel().copy()
        after = np.tile(np.arange(1, w + 1), (n, 1)).ravel()
        before = np.tile(np.arange(-1, w - 1), (n, 1)).ravel()
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self._leaf(symbols[:, :-1], symbols[:, 1:], np.arange(width), width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree = tree.ravel()
        row = np.flatnonzero(tree[1 :: 2 * width] < NONE)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            start = rows * (2 * width)
            node = width + leaf
            tree[start + node] = value
            while True:
                node = node >> 1
                if not node[0]:
                    break
                tree[start + node] = np.minimum(tree[start + 2 * node], tree[start + 2 * node + 1])

        def symbol(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where((place >= 0) & (place < w), flat[rows * w + np.clip(place, 0, w - 1)], -1)

        while len(row):
            root = tree[row * (2 * width) + 1]
            left, new = root % width, self.merged[root // width]
            cell = row * w + left
            right = after[cell]
            flat[cell] = new
            flat[row * w + right] = -1
            follow = after[row * w + right]
            after[cell] = follow
            inside = follow < w
            before[(row * w + follow)[inside]] = left[inside]
            put(row, left, self._leaf(new, symbol(row, follow), left, width))
            ends = right < width
            if ends.any():
                put(row[ends], right[ends], np.full(int(ends.sum()), NONE))
            prior = before[cell]
            has = prior >= 0
            if has.any():
                put(row[has], prior[has], self._leaf(symbol(row[has], prior[has]), new[has], prior[has], width))
            row = row[tree[row * (2 * width) + 1] < NONE]
        return flat.reshape(n, w)

    def encode_pre_tokens(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out = [b""] * len(raw)
        widths = 1 << np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64)
        for width in np.unique(widths).tolist():
            chosen = np.flatnonzero(widths == width)
            # Some 200,000 cells at a time keep the arrays small.
            step = max(1, 200_000 // width)
            for start in range(0, len(chosen), step):
                part = chosen[start : start + step]
                size = sizes[part]
                joined = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                rows = np.repeat(np.arange(len(part)), size)
                places = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
                symbols = np.full((len(part), width + 1), -1, np.int64)
                symbols[rows, places] = self.inner[joined]
                symbols[np.arange(len(part)), size - 1] = self.last[joined[np.cumsum(size) - 1]]
                done = self._merge(symbols, width)
                left = done >= 0
                ids = done[left].astype("<i4").tobytes()
                cuts = [0, *(4 * np.cumsum(left.sum(axis=1))).tolist()]
                for i, a, b in zip(part.tolist(), cuts, cuts[1:]):
                    out[i] = ids[a:b]
        return out

    def learn(self, words: set[str], whole: set[str]) -> None:
        """Encode composed lower-case ``words`` and pre-tokens, which stay ``whole``, that are not kept yet."""
        kept, findall = self.kept, self.vocabulary.pattern.findall
        if len(kept) > MOST_KEPT:
            kept.clear()
            kept.update(self.special)
        new, whole = list(words.difference(kept)), list(whole.difference(kept))
        # A word of letters is one pre-token, a mark behind it another; all others are cut by the pattern.
        cut = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".,!?" and w[:-1].isalpha() else findall(w) for w in new]
        pieces = {p for c in cut for p in c}.union(whole)
        ids = {p: kept[p] for p in pieces if p in kept}
        pieces = list(pieces.difference(ids))
        ids.update(zip(pieces, self.encode_pre_tokens(pieces)))
        for w in whole:
            kept[w] = ids[w]
        for w, c in zip(new, cut):
            kept[w] = ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for start in range(0, len(texts), 256):
            words: set[str] = set()
            whole: set[str] = set()
            cut = []
            for text in texts[start : start + 256]:
                lower = self.vocabulary.plain(text)
                cut.append(self.vocabulary.cut(text) if lower is None else lower.split())
                (whole if lower is None else words).update(cut[-1])
            self.learn(words, whole)
            get = self.kept.__getitem__
            out.extend(b"".join(map(get, c)) for c in cut)
        return out


@lru_cache(maxsize=2)
def merge_tree(path: str) -> MergeTree:
    """One encoder per Python worker."""
    return MergeTree(path)


def encode(df: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``df`` with the token ids of each whole text; ``path`` is a vocabulary file every executor has."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = merge_tree(path).encode(texts_of(batch, text_column))
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in made])])
        return {ids_column: lists(pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()), offsets)}

    return with_columns(df, [text_column], f"{ids_column} array<int>", work)


def decode(df: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``df`` with the decoded text. The file names no decoder, so the pieces are joined by one space.

    Null ids give an empty text; ids outside the vocabulary give no piece.
    """

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        tree = merge_tree(path)
        strings = tree.vocabulary.strings
        column = batch.column(ids_column)
        values = column.flatten()
        if not column.null_count and not values.null_count and len(values):
            least, last = pc.min_max(values).as_py().values()
            if 0 <= least and last < len(strings):
                begins = pc.subtract(column.offsets, column.offsets[0])
                return {text_column: pc.binary_join(pa.ListArray.from_arrays(begins, tree.pieces.take(values)), " ")}
        flat, offsets = values.to_pylist(), column.offsets.to_pylist()
        base, valid = offsets[0], column.is_valid().to_pylist()
        get, most = strings.__getitem__, len(strings)
        texts = []
        for ok, a, b in zip(valid, offsets[:-1], offsets[1:]):
            part = flat[a - base : b - base] if ok else []
            try:
                texts.append(" ".join(map(get, part)))
            except (IndexError, TypeError):
                texts.append(" ".join([strings[i] for i in part if i is not None and 0 <= i < most]))
        return {text_column: pa.array(texts, pa.string())}

    return with_columns(df, [ids_column], f"{text_column} string", work)
