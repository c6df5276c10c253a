"""Toxicity scores from a lexicon matched with spelling errors and from the words around each match.

1. A lexicon is learnt from labelled documents: words and word beginnings that stand almost only in toxic ones.
   Counting, and leaving out terms that a shorter beginning covers, are Spark aggregations and joins; all others stay.
2. Its trie is intersected with the Levenshtein automata of its words, so that each entry is met within its number of
   edits (``edits_for``); beginnings must match exactly and may go on at will. States are made in the tasks when a
   word first reaches them. Lookalikes that clean documents use are learnt too and left out.
3. The automaton runs over the distinct words of a batch at once. A match between two paired quote marks is quoted, one
   after a verb of reporting in its clause is reported; ``CONTEXT`` bounds how far such a verb or a form of address
   may be. Quoted, reported and plain matches are features of their own.
4. A logistic model turns the counts of a document into a score. It is fitted on at most ``TRAINING_ROWS`` labelled
   rows, the documents with the least hash of their id, so that the choice is the same on each run.

Texts are scored where they lie. Only the trie and the weights are sent to the tasks; each entry stands in at
least ``LEAST_TOXIC`` of the ``TRAINING_ROWS`` documents, which bounds them.

Defined cases: null and empty texts have no match and get the score of a text without one; repeated rows get the
same score; a null ``doc_id`` is never labelled and not held out; rows without a label are not trained on; without labelled
documents of both kinds fixed weights serve; an empty table gives an empty table. Clashing extra columns are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import Batches, durable, texts_of, with_columns

TRAINING_ROWS = 12_000
LEAST_TOXIC = 5
LEAST_SHARE = 0.9
BEGINNINGS = range(4, 8)
# A beginning becomes the whole word when one word makes up this share of its documents.
ONE_WORD_SHARE = 0.7
CONTEXT = 8
# Bounds of a worker's memory, not of the lexicon.
MOST_CELLS = 4_000_000
SLICE_WORDS = 4_096
THRESHOLD = 0.3

WORDS = re.compile(r"\w+")
TOKENS = re.compile(r"\w+|[\"“”„«».!?;\n]")
# Quote marks and their family.
QUOTES = {**dict.fromkeys('"', "straight"), **dict.fromkeys("“”„", "curly"), **dict.fromkeys("«»", "angle")}
CLAUSE_ENDS = frozenset(".!?;\n")
# Verbs of reporting and forms of address in four languages.
REPORTING = frozenset("said says wrote called quoted quote dit écrit cité sagte schrieb zitierte dijo escribió citó".split())
ADDRESS = frozenset("you your yours du dich dir dein tu te toi vous votre usted ustedes vosotros".split())

FEATURES = ("any_match", "exact", "inexact", "addressed", "share", "quoted", "reported")
# Weights used when nothing can be fitted: a match that is neither quoted nor reported makes a text toxic.
FALLBACK = np.array([-3.0, 3.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0])


def edits_for(word: str) -> int:
    """Edits allowed in a lexicon word."""
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


class Automaton:
    """Levenshtein automata of the entries over their trie, made deterministic as far as words ask for it.

    A state is a set of (trie node, edits spent); state 0 is dead. Only the trie is built beforehand and sent to tasks.
    A transition is worked out when a word first takes it and kept in a table of at most ``MOST_CELLS`` cells before a
    slice of ``SLICE_WORDS`` words, so memory does not grow with the lexicon's states.
    """

    def __init__(self, words: list[str], beginnings: list[str], ignored: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = []
        self.budget: list[int] = []
        self.ends: set[int] = set()
        self.opens: set[int] = set()
        self.ignored = ignored
        # One trie per number of edits, so that a short word never borrows the edits of a long one.
        roots: dict[int, int] = {}
        for entries, marks, edits_of in ((words, self.ends, edits_for), (beginnings, self.opens, lambda _: 0)):
            own = {}
            for text in entries:
                edits = edits_of(text)
                if edits not in own:
                    own[edits] = self._node(edits)
                marks.add(self._insert(text, edits, own[edits]))
            roots.update({(edits, marks is self.opens): root for edits, root in own.items()})
        letters = sorted({c for text in [*words, *beginnings] for c in text})
        self.letters: list[str | None] = [None, *letters]
        self.classes = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 1
        self.first = self._closed({root: 0 for root in roots.values()})
        self._forget()

    def _node(self, edits: int) -> int:
        self.children.append({})
        self.budget.append(edits)
        return len(self.children) - 1

    def _insert(self, text: str, edits: int, node: int) -> int:
        for c in text:
            if c not in self.children[node]:
                self.children[node][c] = self._node(edits)
            node = self.children[node][c]
        return node

    def _forget(self) -> None:
        """Start anew with the dead and the first state."""
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full((64, len(self.letters)), -1, np.int32)
        self.edits = np.full(64, -1, np.int8)
        self._number(())
        self.start = self._number(self.first)

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.edits = np.concatenate([self.edits, np.full_like(self.edits, -1)])
            found = [spent for node, spent in state if node in self.ends or node in self.opens]
            self.edits[n] = min(found, default=-1)
            if not state:
                self.table[n] = 0
        return self.numbers[state]

    def _closed(self, spent: dict[int, int]) -> tuple:
        """Skipping a trie letter costs an edit."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            if spent[node] < self.budget[node]:
                for child in self.children[node].values():
                    if spent[node] + 1 < spent.get(child, 99):
                        spent[child] = spent[node] + 1
                        todo.append(child)
        return tuple(sorted(spent.items()))

    def _step(self, state: tuple, letter: str | None) -> tuple:
        after: dict[int, int] = {}

        def put(node: int, spent: int) -> None:
            if spent < after.get(node, 99):
                after[node] = spent

        for node, spent in state:
            if node in self.opens:
                put(node, spent)
                continue
            if letter in self.children[node]:
                put(self.children[node][letter], spent)
            if spent < self.budget[node]:
                put(node, spent + 1)
                for child in self.children[node].values():
                    put(child, spent + 1)
        return self._closed(after)

    def matches(self, words: list[str]) -> dict[str, int]:
        """The accepted words and their edits."""
        found: dict[str, int] = {}
        for start in range(0, len(words), SLICE_WORDS):
            if self.table.size > MOST_CELLS:
                self._forget()
            found.update(self._match(words[start : start + SLICE_WORDS]))
        return found

    def _match(self, words: list[str]) -> dict[str, int]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[np.minimum(points, len(self.classes) - 1)]
        starts = np.cumsum(sizes) - sizes
        state, live, at = np.full(len(words), self.start, np.int64), np.flatnonzero(sizes), 0
        while len(live):
            now, kind = state[live], kinds[starts[live] + at]
            unknown = self.table[now, kind] < 0
            if unknown.any():
                for n, k in {*zip(now[unknown].tolist(), kind[unknown].tolist())}:
                    # Numbered first: that may replace the table by a larger one.
                    to = self._number(self._step(self.states[n], self.letters[k]))
                    self.table[n, k] = to
            state[live] = self.table[now, kind]
            at += 1
            live = live[(state[live] > 0) & (sizes[live] > at)]
        edits = self.edits[state]
        return {w: int(edits[i]) for i in np.flatnonzero(edits >= 0).tolist() if (w := words[i]) not in self.ignored}

    def __getstate__(self) -> dict:
        """Without the states met so far, so that tasks receive the trie alone."""
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "numbers", "table", "edits", "start")}

    def __setstate__(self, values: dict) -> None:
        self.__dict__.update(values)
        self._forget()


def quoted_places(tokens: list[str]) -> set[int]:
    """Places between two paired marks of one family in one line; a mark without a partner quotes nothing."""
    inside: set[int] = set()
    opened: dict[str, int] = {}
    for i, token in enumerate(tokens):
        if token == "\n":
            opened.clear()
        elif token in QUOTES:
            family = QUOTES[token]
            if family in opened:
                inside.update(range(opened.pop(family) + 1, i))
            else:
                opened[family] = i
    return inside


def reported(tokens: list[str], place: int) -> bool:
    """Whether a verb of reporting stands before ``place`` in its clause, at most ``CONTEXT`` tokens away."""
    for token in reversed(tokens[max(0, place - CONTEXT) : place]):
        if token in CLAUSE_ENDS:
            return False
        if token in REPORTING:
            return True
    return False


def match_counts(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """The values of FEATURES for each text."""
    low = [t.lower() for t in texts]
    cut = [WORDS.findall(t) for t in low]
    found = automaton.matches(list(set().union(*cut))) if texts else {}
    out = np.zeros((len(texts), len(FEATURES)))
    for row, words in enumerate(cut):
        if not found or found.keys().isdisjoint(words):
            continue
        tokens = TOKENS.findall(low[row])
        inside = quoted_places(tokens)
        exact = inexact = addressed = in_quotes = in_reports = 0
        for i in [i for i, t in enumerate(tokens) if t in found]:
            if i in inside:
                in_quotes += 1
            elif reported(tokens, i):
                in_reports += 1
            else:
                exact += found[tokens[i]] == 0
                inexact += found[tokens[i]] > 0
                addressed += not ADDRESS.isdisjoint(tokens[max(0, i - CONTEXT) : i + 1 + CONTEXT])
        hits = exact + inexact
        share = 10 * hits / max(len(words), 10)
        out[row] = hits > 0, *map(math.log1p, (exact, inexact, addressed)), share, math.log1p(in_quotes), math.log1p(in_reports)
    return out


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        counts = match_counts(self.automaton, texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + counts @ self.weights[1:], -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge; no match may speak for a clean text."""
    if not 0 < y.sum() < len(y):
        return FALLBACK.copy()
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def choose_entries(qualified: DataFrame) -> DataFrame:
    """(term, begins) of the lexicon from the qualified (term, begins, toxic).

    Of beginnings the shortest stay; one whose documents mostly share one word gives way to its words, and the
    others cover theirs. The shortest beginnings are free of each other's prefixes, so a word meets one at most.
    """
    def prefixes(of: Column, longest: Column) -> Column:
        lengths = F.array(*[F.lit(k) for k in BEGINNINGS])
        return F.transform(F.filter(lengths, lambda k: k <= longest), lambda k: F.substring(of, F.lit(1), k))

    size = F.length("term")
    starts = qualified.filter("begins").select(F.col("term").alias("start"), F.col("toxic").alias("start_toxic"))
    longer = qualified.filter("begins").select("term", F.explode(prefixes(F.col("term"), size - 1)).alias("start"))
    covered = longer.join(starts, "start", "left_semi").select(F.col("term").alias("start"))
    shortest = starts.join(covered, "start", "left_anti")
    words = qualified.filter("NOT begins").select("term", "toxic")
    below = words.select("term", "toxic", F.explode(prefixes(F.col("term"), size)).alias("start")).join(shortest, "start")
    one_word = below.filter(F.col("toxic") >= ONE_WORD_SHARE * F.col("start_toxic")).select("start").distinct()
    beginnings = shortest.join(one_word, "start", "left_anti").select(F.col("start").alias("term"))
    held = below.join(beginnings.withColumnRenamed("term", "start"), "start", "left_semi").select("term")
    return words.join(held, "term", "left_anti").select("term", F.lit(False).alias("begins")).unionByName(
        beginnings.withColumn("begins", F.lit(True))
    )


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never trained on."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    # At most TRAINING_ROWS rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = durable(training_texts(docs, labels), "toxic_training")

    def terms(batches: Batches) -> Batches:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                names, begins, toxic = [], [], []
                for text, label in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist()):
                    words = set(WORDS.findall(text.lower()))
                    cut = {w[:k] for w in words for k in BEGINNINGS if len(w) >= k}
                    names += [*words, *cut]
                    begins += [False] * len(words) + [True] * len(cut)
                    toxic += [label] * (len(words) + len(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(begins, pa.bool_()), pa.array(toxic, pa.int64())], names=["term", "begins", "toxic"]
                )

    counted = rows.mapInArrow(terms, "term string, begins boolean, toxic long").groupBy("term", "begins").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")
    )
    qualified = counted.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    # An entry stands in LEAST_TOXIC of at most TRAINING_ROWS documents.
    chosen = choose_entries(durable(qualified, "toxic_terms")).collect()
    words, beginnings = (sorted(r.term for r in chosen if r.begins == begins) for begins in (False, True))
    automaton = Automaton(words, beginnings)

    def lookalikes(batches: Batches) -> Batches:
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text, label in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist()):
                for word, edits in automaton.matches(list(set(WORDS.findall(text.lower())))).items():
                    if edits:
                        found[word, label] = found.get((word, label), 0) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int64()), pa.array(list(found.values()), pa.int64()),
            ], names=["word", "toxic", "n"])

    n, toxic = F.sum("n"), F.sum(F.col("n") * F.col("toxic"))
    # Words of the training rows within the automaton's reach.
    clean = rows.mapInArrow(lookalikes, "word string, toxic long, n long").groupBy("word").agg((toxic / n).alias("share")).filter("share < 0.5").collect()
    automaton = Automaton(words, beginnings, frozenset(r.word for r in clean))

    def counts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = match_counts(automaton, texts_of(batch, "text"))
        return {f: pa.array(made[:, i]) for i, f in enumerate(FEATURES)}

    table = with_columns(rows, ["text"], ", ".join(f"{f} double" for f in FEATURES), counts, drop=("text",)).collect()
    x = np.array([[r[f] for f in FEATURES] for r in table]).reshape(-1, len(FEATURES))
    return Model(automaton, fit_weights(x, np.array([r.toxic for r in table], float)))


def score(df: DataFrame, model: Model, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``score`` from 0 to 1 and ``predicted``."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = model.scores(texts_of(batch, text_column))
        return {"score": pa.array(made), "predicted": pa.array((made >= THRESHOLD).astype("i4"))}

    return with_columns(df, [text_column], "score double, predicted int", work, drop=() if keep_text else (text_column,))
