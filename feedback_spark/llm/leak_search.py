"""Benchmark decontamination with BM25 and block-max pruning.

1. Test items (pieces of at most ``PIECE_WORDS`` words of long ones) form an inverted index with BM25 weights, each
   divided by the item's own full score, so that 1 means that all of an item's weight is found. Items stand in blocks
   of ``BLOCK_ITEMS``; a term keeps its greatest weight per block and over all.
2. Every passage of every document, ``2 * PIECE_WORDS`` words with half of it shared with the next, is a query. Its terms
   are ordered by greatest weight; those whose sum stays below the threshold cannot lift an item over it alone, so
   only the blocks of the other terms are opened (the pivot of WAND). A block whose greatest weights together stay
   below the threshold is skipped (block-max), the items of the others are scored in full. All passages of a batch take
   each step at once. Nothing at or above the threshold is lost.
3. A second index holds the word triples of the items, so that pieces of an item that lie far apart in a document, or
   whose few rare words are missing, are found too: no pair that the rules of step 4 call a leak depends on the BM25
   score, items of under five words excepted.
4. Each document and item found is verified on the whole text by shared word triples. A document leaks an item when it
   holds more than ``LEAST_WHOLE`` of the triples of question and answer together; below that the answer decides: at
   least ``LEAST_QUESTION`` of the question and ``LEAST_ANSWER`` of the answer. ``score`` is the best BM25 score in any case.

The index is built for ``INDEX_BYTES`` of item text at a time and sent to the tasks; more items mean further
passes over the documents, never a larger index. Documents are not shuffled.

An item's answer is its last sentence or line, its question all before; of a single sentence the last quarter is the
answer. Defined cases: null and empty texts and items match nothing; repeated items and rows are found one by one, a null
``item_id`` or ``doc_id`` is kept; without items or documents the result is empty. Other columns pass or are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedback_spark.llm.frames import Batches, durable, slices, texts_of, unused, with_columns

PIECE_WORDS = 64
BLOCK_ITEMS = 16
THRESHOLD = 0.5
K1, B = 1.2, 0.75
TUPLE = 3
LEAST_QUESTION = 0.6
LEAST_ANSWER = 0.5
LEAST_WHOLE = 0.6
INDEX_BYTES = 16_000_000
# Texts judged at a time; their words and ids are held side by side.
JUDGED_ROWS = 256
JUDGED_BYTES = 500_000

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words_of, SENTENCE_END.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:] or words


def tuples(words: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(n))))


def overlap(part: list[str], text: list[str], known: dict[int, set]) -> float:
    """Share of the word triples of ``part`` (one tuple when it is shorter) that ``text`` holds."""
    n = min(TUPLE, len(part))
    if not n:
        return 0.0
    if n not in known:
        known[n] = tuples(text, n)
    wanted = tuples(part, n)
    return len(wanted & known[n]) / len(wanted)


class Index:
    """Inverted index of items with greatest weights per block."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[str, int], n_pieces: int, mean_size: float):
        self.items = items
        self.parts = [question_and_answer(t) for _, t in items]
        self.words = [words_of(t) for _, t in items]
        pieces = [(i, w[s : s + PIECE_WORDS]) for i, w in enumerate(self.words) for s in range(0, len(w), PIECE_WORDS)]
        self.item_of = np.array([i for i, _ in pieces], np.int64)
        self.terms: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        for number, (_, words) in enumerate(pieces):
            weights = {}
            for w in words:
                weights[w] = weights.get(w, 0) + 1
            for w, tf in weights.items():
                n = frequency.get(w, 1)
                idf = math.log(1 + (n_pieces - n + 0.5) / (n + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_size))
            full = sum(weights.values())
            rows += [(self.terms.setdefault(w, len(self.terms)), number, v / full) for w, v in weights.items()]
        table = np.array(sorted(rows), np.float64).reshape(-1, 3)
        term, piece, self.weight = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.piece = piece
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        block = piece // BLOCK_ITEMS
        self.n_blocks = int(block.max()) + 1 if len(block) else 0
        keys, place = np.unique(term * max(self.n_blocks, 1) + block, return_inverse=True)
        self.block_weight = np.zeros(len(keys))
        np.maximum.at(self.block_weight, place, self.weight)
        self.block = keys % max(self.n_blocks, 1)
        self.block_starts = np.searchsorted(keys // max(self.n_blocks, 1), np.arange(len(self.terms) + 1))
        self.greatest = np.zeros(len(self.terms))
        np.maximum.at(self.greatest, term, self.weight)
        self._index_tuples()

    def _index_tuples(self) -> None:
        """The items of each word tuple, and how many of its tuples a document must hold to leak an item."""
        cut = self.words
        ids, owner = self.numbered(cut), np.repeat(np.arange(len(cut)), [len(w) for w in cut])
        # Tuples are numbered word by word: a level holds the keys (number of the words before, next word).
        self.levels: list[np.ndarray] = []
        for n in range(2, TUPLE + 1):
            self.levels.append(np.zeros(0, np.int64))
            self.levels[-1] = np.unique(self._tuple_keys(ids, owner, n)[1])
        owner, key = self._tuple_keys(ids, owner, TUPLE)
        held = np.unique(np.searchsorted(self.levels[-1], key) * max(len(cut), 1) + owner)
        key, self.tuple_item = np.divmod(held, max(len(cut), 1))
        self.tuple_starts = np.searchsorted(key, np.arange(len(self.levels[-1]) + 1))
        self.needed = np.full(len(cut), np.inf)
        for i, n in enumerate(np.bincount(self.tuple_item, minlength=len(cut)).tolist()):
            question, answer = (share * len(tuples(p, TUPLE)) for p, share in zip(self.parts[i], (LEAST_QUESTION, LEAST_ANSWER)))
            if n:
                self.needed[i] = max(1.0, min(LEAST_WHOLE * n, question or answer or 1.0))

    def _tuple_keys(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, key in level ``n``) of each run of ``n`` words whose beginning is a known tuple."""
        at = np.flatnonzero(ids[: max(0, len(ids) - n + 1)] >= 0)
        at = at[(owner[at] == owner[at + n - 1]) & (ids[at + n - 1] >= 0)]
        number = ids[at]
        for k in range(1, n):
            if k > 1:
                level = self.levels[k - 2]
                place = np.minimum(np.searchsorted(level, number), max(len(level) - 1, 0))
                same = level[place] == number if len(level) else np.zeros(len(number), bool)
                at, number = at[same], place[same]
            known = ids[at + k] >= 0
            at = at[known]
            number = number[known] * len(self.terms) + ids[at + k]
        return owner[at], number

    def numbered(self, cut: list[list[str]]) -> np.ndarray:
        """The numbers of the words of all texts, -1 for those of no item."""
        get = self.terms.get
        return np.array([get(w, -1) for words in cut for w in words], np.int64)

    def share_tuples(self, cut: list[list[str]], ids: np.ndarray) -> list[list[int]]:
        """For each text the items of which it holds as many word tuples as a leak needs."""
        owner, key = self._tuple_keys(ids, np.repeat(np.arange(len(cut)), [len(w) for w in cut]), TUPLE)
        level = self.levels[-1]
        place = np.minimum(np.searchsorted(level, key), max(len(level) - 1, 0))
        same = level[place] == key if len(level) else np.zeros(len(key), bool)
        owner, place = np.divmod(np.unique(owner[same] * max(len(level), 1) + place[same]), max(len(level), 1))
        at, entry = expand(self.tuple_starts, place)
        pairs, n = np.unique(owner[at] * max(len(self.items), 1) + self.tuple_item[entry], return_counts=True)
        text, item = np.divmod(pairs, max(len(self.items), 1))
        enough = n >= self.needed[item] - 1e-9
        out: list[list[int]] = [[] for _ in cut]
        for t, i in zip(text[enough].tolist(), item[enough].tolist()):
            out[t].append(i)
        return out

    def best_score(self, words: list[str], item: int) -> float:
        """The best score of a piece of the item over the passages of a text."""
        terms = {w: t for w in set(words) if (t := self.terms.get(w)) is not None}
        best = 0.0
        for piece in range(*np.searchsorted(self.item_of, (item, item + 1)).tolist()):
            weights = {}
            for w, t in terms.items():
                run = self.piece[self.starts[t] : self.starts[t + 1]]
                k = int(np.searchsorted(run, piece))
                if k < len(run) and run[k] == piece:
                    weights[w] = float(self.weight[self.starts[t] + k])
            for start in range(0, max(1, len(words) - PIECE_WORDS), PIECE_WORDS):
                best = max(best, sum(weights[w] for w in weights.keys() & set(words[start : start + 2 * PIECE_WORDS])))
        return best

    def retrieve(self, cut: list[list[str]], ids: np.ndarray | None = None) -> list[dict[int, float]]:
        """For each text the items that one of its passages reaches, with the best score."""
        found: list[dict[int, float]] = [{} for _ in cut]
        ids = self.numbered(cut) if ids is None else ids
        sizes = np.array([len(w) for w in cut], np.int64)
        halves = -(-sizes // PIECE_WORDS)
        passages = np.maximum(halves - 1, (sizes > 0).astype(np.int64))
        first = np.cumsum(passages) - passages
        text = np.repeat(np.arange(len(cut)), sizes)
        half = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PIECE_WORDS
        known = np.flatnonzero(ids >= 0)
        text, half, ids = text[known], half[known], ids[known]
        low, high = np.maximum(half - 1, 0), np.minimum(half, passages[text] - 1)
        twice = high > low
        passage = np.concatenate([first[text] + low, (first[text] + high)[twice]])
        pairs = np.unique(passage * max(len(self.terms), 1) + np.concatenate([ids, ids[twice]]))
        passage, term = np.divmod(pairs, max(len(self.terms), 1))
        if not len(passage):
            return found
        # Terms of a passage by greatest weight: those before the threshold is reached open no block.
        order = np.lexsort((self.greatest[term], passage))
        passage, term = passage[order], term[order]
        bound = np.cumsum(self.greatest[term])
        start = np.flatnonzero(np.diff(passage, prepend=-1))
        group = np.cumsum(np.diff(passage, prepend=-1) > 0) - 1
        bound -= (bound[start] - self.greatest[term[start]])[group]
        opens = bound >= THRESHOLD
        closed = np.bincount(passage, np.where(opens, 0.0, self.greatest[term]), int(passages.sum()))
        at, place = expand(self.block_starts, term[opens])
        keys = passage[opens][at] * self.n_blocks + self.block[place]
        keys, inverse = np.unique(keys, return_inverse=True)
        most = np.bincount(inverse, self.block_weight[place], len(keys)) + closed[keys // self.n_blocks]
        keys = keys[most >= THRESHOLD - 1e-9]
        if not len(keys):
            return found
        # Full scores in the blocks that are left.
        wanted = np.isin(passage, keys // self.n_blocks)
        passage, term = passage[wanted], term[wanted]
        at, place = expand(self.starts, term)
        inside = np.isin(passage[at] * self.n_blocks + self.piece[place] // BLOCK_ITEMS, keys)
        at, place = at[inside], place[inside]
        n_pieces = len(self.item_of)
        keys, inverse = np.unique(passage[at] * n_pieces + self.piece[place], return_inverse=True)
        scores = np.bincount(inverse, self.weight[place], len(keys))
        owner = np.repeat(np.arange(len(cut)), passages)
        for key, value in zip(keys[scores >= THRESHOLD - 1e-9].tolist(), scores[scores >= THRESHOLD - 1e-9].tolist()):
            here, item = found[owner[key // n_pieces]], int(self.item_of[key % n_pieces])
            here[item] = max(here.get(item, 0.0), value)
        return found

    def judge(self, texts: list[str]) -> list[list[tuple[int, float, float, float, bool]]]:
        """(item, score, question overlap, answer overlap, leaked) of each text, by item: those that BM25 finds and all leaks."""
        cut = list(map(words_of, texts))
        ids = self.numbered(cut)
        out = []
        for words, found, near in zip(cut, self.retrieve(cut, ids), self.share_tuples(cut, ids)):
            known: dict[int, set] = {}
            rows = []
            for i in sorted({*found, *near}):
                question, answer = self.parts[i]
                parts = overlap(question, words, known), overlap(answer, words, known)
                leaked = is_leak(*parts, overlap(self.words[i], words, known))
                if i in found or leaked:
                    rows.append((i, found[i] if i in found else self.best_score(words, i), *parts, leaked))
            out.append(rows)
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """(item, score, question overlap, answer overlap) of each text, by item."""
        return [[row[:4] for row in rows] for rows in self.judge(texts)]


def expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its run of entries: (number of the term in ``terms``, entry)."""
    run = starts[terms + 1] - starts[terms]
    at = np.repeat(np.arange(len(terms)), run)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(run) - run, run) + np.repeat(starts[terms], run)


def is_leak(question: float, answer: float, whole: float = 0.0) -> bool:
    return whole > LEAST_WHOLE or question >= LEAST_QUESTION and answer >= LEAST_ANSWER


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES):
    """The items' indexes, one after another, each of about ``index_bytes`` of text, with weights from all items."""
    items = durable(items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "items")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / index_bytes))

    def pieces(batches: Batches) -> Batches:
        for batch in batches:
            cut = [w[s : s + PIECE_WORDS] for t in texts_of(batch, "text") for w in [words_of(t)] for s in range(0, len(w), PIECE_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.string()))], names=["words"])

    cut = items.mapInArrow(pieces, "words array<string>")
    n_pieces, mean_size = cut.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    counted = durable(cut.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "item_words")
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        own = items.filter(share == part)
        rows = own.orderBy("item_id", "text").collect()  # about index_bytes
        used = own.mapInArrow(pieces, "words array<string>").select(F.explode("words").alias("word")).distinct()
        frequency = {r.word: r.n for r in counted.join(used, "word", "left_semi").collect()}
        yield Index([(r.item_id, r.text) for r in rows], frequency, n_pieces, mean_size or 1.0)


def leaks(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, leaked) of every document and item that BM25 finds or that is a leak."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leaked boolean"
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    result = None
    for index in indexes(items):

        def run(batches: Batches, index: Index = index) -> Batches:
            for whole in batches:
                for batch in slices(whole, ["text"], JUDGED_ROWS, JUDGED_BYTES):
                    rows = [
                        (doc, index.items[i][0], score, question, answer, leaked)
                        for doc, found in zip(batch.column("doc_id").to_pylist(), index.judge(texts_of(batch, "text")))
                        for i, score, question, answer, leaked in found
                    ]
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                    columns = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

        found = docs.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leaked"]


def without_leaks(df: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that leak no item, all columns as they are."""
    flag = unused(df, "leaked")
    for index in indexes(items):

        def work(batch: pa.RecordBatch, index: Index = index) -> dict[str, pa.Array]:
            found = [f for part in slices(batch, [text_column], JUDGED_ROWS, JUDGED_BYTES) for f in index.judge(texts_of(part, text_column))]
            return {flag: pa.array([any(leaked for *_, leaked in f) for f in found], pa.bool_())}

        df = with_columns(df, [text_column], f"`{flag}` boolean", work).filter(~F.col(flag)).drop(flag)
    return df
