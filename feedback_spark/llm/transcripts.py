"""Roles of transcript turns by a hidden Markov model, and canonical turns.

A transcript is the lines of a conversation's rows in turn order. Each line shows a speaker marker or none, its length,
whether it opens a row, ends with a question mark, or looks like a list or code. The hidden state of a line is its speaker's
role. Within a row the role changes only at a marker; between rows it follows the transitions learnt from labelled
conversations. Viterbi finds the likeliest roles of a whole conversation. A row that holds several marked speakers falls
into several turns.

1. Rows are ranged by conversation and turn, so a conversation of any length spreads over parts, and are stored.
2. Emissions and transitions are counted on conversations of the training fold; only these counts, whose number the
   features bound, reach the driver.
3. Each part sums up its first and last conversation as a matrix of the best path from every role before to every role
   after it. The driver joins these few matrices, one or two per part, and so knows for each part the scores before its first line
   and the role after its last one.
4. Each part then runs Viterbi with those ends. The roles are those of one Viterbi run over the whole conversation.

Defined cases: null and empty texts are one empty line; rows of equal conversation and turn are ordered by a hash of their
text; a null conversation is one of its own, a null turn stands first; repeated rows give repeated turns; roles outside the model
are not trained on; without training rows all roles are alike likely and markers alone decide. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import Batches, durable

ROLES = ("system", "user", "assistant", "tool")
START = len(ROLES)
# Names of speakers at the start of a line.
SPEAKERS = {
    "system": "system instructions prompt sys",
    "user": "user human question q client customer me you utilisateur benutzer usuario mensch humain",
    "assistant": "assistant ai bot answer a agent model response assistent asistente chatbot",
    "tool": "tool function observation output result werkzeug outil herramienta",
}
ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names.split()}
MARKER = re.compile(
    r"^[\s>*#\-]*(?:<\|(?:im_start\|>)?|\[|\(|\*{1,2}|###\s*)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True))
    + r")(?:\s*\d+)?\s*(?:\|>|\]|\)|\*{0,2}\s*:\*{0,2})\s*", re.I)
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
CODE = re.compile(r"^(?:```|\t| {4})|[{};]\s*$")
FEATURES = (len(ROLES) + 1, 7, 2, 2, 3)  # values of: marker, length, opens a row, question, form
MARKER_WEIGHT = 1e6
SMOOTHING = 0.5
STAY = np.log(0.999)


def line_features(line: str, opens: bool) -> tuple[int, int, int, int, int]:
    found = MARKER.match(line)
    marker = ROLES.index(ROLE_OF[found[1].lower()]) + 1 if found else 0
    length = min(6, len(line.split()).bit_length())
    form = 1 if ITEM.match(line) else 2 if CODE.search(line) else 0
    return marker, length, int(opens), int(line.rstrip().endswith("?")), form


def without_marker(line: str) -> str:
    found = MARKER.match(line)
    return line[found.end() :] if found else line


class Model:
    """Log probabilities of the chain."""

    def __init__(self, emitted: dict[tuple[int, int, int], int], followed: dict[tuple[int, int], int]):
        n = len(ROLES)
        self.emission = []
        for feature, size in enumerate(FEATURES):
            table = np.full((n, size), SMOOTHING)
            for (f, role, value), count in emitted.items():
                if f == feature:
                    table[role, value] += count
            if feature == 0:  # what a marker says does not depend on how often the training rows carry one
                table = np.ones((n, size))
                table[np.arange(n), np.arange(n) + 1] = MARKER_WEIGHT
            self.emission.append(np.log(table / table.sum(axis=1, keepdims=True)))
        table = np.full((n + 1, n), SMOOTHING)
        for (a, b), count in followed.items():
            table[a, b] += count
        self.between = np.log(table / table.sum(axis=1, keepdims=True))
        self.inside = np.full((n, n), np.log((1 - np.exp(STAY)) / (n - 1)))
        np.fill_diagonal(self.inside, STAY)
        self.switch = np.full((n, n), -np.log(n))

    def emit(self, features: tuple[int, ...]) -> np.ndarray:
        return sum(table[:, value] for table, value in zip(self.emission, features))

    def move(self, features: tuple[int, ...]) -> np.ndarray:
        """Transitions into a line that is not the conversation's first."""
        return self.between[:-1] if features[2] else self.switch if features[0] else self.inside


def viterbi(model: Model, lines: list[tuple[int, ...]], before: np.ndarray | None = None, last: int | None = None) -> list[int]:
    """The likeliest roles of ``lines``; ``before`` holds the scores of the line before them, ``last`` the role to end in."""
    if not lines:
        return []
    back, score = [], None
    for i, features in enumerate(lines):
        if i == 0 and before is None:
            score = model.between[START] + model.emit(features)
            back.append(None)
            continue
        paths = (before if i == 0 else score)[:, None] + model.move(features)
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + model.emit(features)
    state = int(score.argmax()) if last is None else last
    out = [state]
    for pointers in reversed(back[1:]):
        state = int(pointers[state])
        out.append(state)
    return out[::-1]


def best_paths(model: Model, lines: list[tuple[int, ...]], begins: bool) -> np.ndarray:
    """Best score from each role before ``lines`` (one row when the conversation begins with them) to each role at their end."""
    total = None
    for i, features in enumerate(lines):
        emit = model.emit(features)
        if i == 0:
            total = (model.between[START][None, :] if begins else model.move(features)) + emit
        else:
            total = (total[:, :, None] + model.move(features)[None]).max(axis=1) + emit
    return total


def training_fold(id_column: str = "conv_id") -> Column:
    """Three of four conversations."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 != 2, F.lit(True))


def ordered_rows(df: DataFrame) -> DataFrame:
    """(part, place, conv, turn, role, text), stored: parts follow each other in the order of conversations and turns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.col("role").cast("string") if "role" in df.columns else F.lit(None).cast("string")
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    keys = ("conv", "turn", "tie")
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return durable(placed.select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "conv", "turn", "role", "text"
    ), "turns")


def in_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "place")


def conversations(batches: Batches):
    """Runs of rows of one part and conversation, as (part, conv, rows), in order."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["part"], row["conv"]) != key and held:
                yield *key, held
                held = []
            key = (row["part"], row["conv"])
            held.append(row)
    if held:
        yield *key, held


def lines_of(rows: list[dict]) -> list[tuple[int, ...]]:
    return [line_features(line, i == 0) for row in rows for i, line in enumerate(row["text"].split("\n"))]


def learn(rows: DataFrame) -> Model:
    """Counts over the training fold; pairs of turns that a part's border divides are put together on the driver."""
    numbers = {r: i for i, r in enumerate(ROLES)}

    def count(batches: Batches) -> Batches:
        found: dict[tuple[int, int, int], int] = {}
        edges: list[tuple] = []
        part, first, last = None, None, None

        def add(*key: int) -> None:
            found[key] = found.get(key, 0) + 1

        for number, conv, held in conversations(batches):
            roles = [numbers.get((r["role"] or "").lower()) for r in held]
            if number != part:
                if part is not None:
                    edges.append((part, *first, *last))
                part, first = number, (conv, roles[0])
            elif roles[0] is not None:
                add(-1, START, roles[0])
            last = (conv, roles[-1])
            for a, b in zip(roles, roles[1:]):
                if a is not None and b is not None:
                    add(-1, a, b)
            for role, row in zip(roles, held):
                if role is not None:
                    for i, line in enumerate(row["text"].split("\n")):
                        for feature, value in enumerate(line_features(line, i == 0)):
                            add(feature, role, value)
        if part is not None:
            edges.append((part, *first, *last))
        rows = [(*k, n, None, None, None) for k, n in found.items()] + [(e[0], None, None, None, e[1:], None, None) for e in edges]
        yield pa.RecordBatch.from_pydict({
            "a": [r[0] for r in rows], "b": [r[1] for r in rows], "c": [r[2] for r in rows], "n": [r[3] for r in rows],
            "edge": [None if r[4] is None else [-1 if x is None else x for x in (r[4][1], r[4][3])] for r in rows],
            "convs": [None if r[4] is None else [r[4][0], r[4][2]] for r in rows],
        }, schema=COUNT_SCHEMA)

    fold = rows.filter(training_fold("conv"))
    counted = in_parts(fold).mapInArrow(count, "a int, b int, c int, n long, edge array<int>, convs array<long>")
    counted = durable(counted, "turn_counts")
    sums = counted.filter("edge IS NULL").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()
    emitted = {(r.a, r.b, r.c): r.n for r in sums if r.a >= 0}
    followed = {(r.b, r.c): r.n for r in sums if r.a < 0}
    before = None
    for r in sorted(counted.filter("edge IS NOT NULL").collect(), key=lambda r: r.a):  # one row per part
        (first, last), (conv, ending) = r.edge, r.convs
        same = before is not None and before[0] == conv
        if first >= 0 and not (same and before[1] < 0):
            key = (before[1] if same else START, first)
            followed[key] = followed.get(key, 0) + 1
        before = (ending, last)
    return Model(emitted, followed)


COUNT_SCHEMA = pa.schema([
    ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("edge", pa.list_(pa.int32())), ("convs", pa.list_(pa.int64())),
])


END_SCHEMA = pa.schema([
    ("part", pa.int32()), ("first", pa.int64()), ("paths", pa.list_(pa.float64())), ("begun", pa.list_(pa.float64())),
    ("last", pa.int64()), ("ending", pa.list_(pa.float64())), ("single", pa.bool_()),
])


def part_ends(rows: DataFrame, model: Model) -> dict[int, tuple[np.ndarray | None, int | None]]:
    """For each part the scores before its first line, if its first conversation began earlier, and the role at its end, if its last goes on."""

    def sum_up(batches: Batches) -> Batches:
        part, made = None, {}
        for number, conv, held in conversations(batches):
            if number != part:
                if part is not None:
                    yield row(part, made)
                part, made = number, {"first": (conv, best_paths(model, lines_of(held), False), best_paths(model, lines_of(held), True)), "n": 0}
            else:
                made["last"] = (conv, held)
            made["n"] += 1
        if part is not None:
            yield row(part, made)

    def row(part: int, made: dict) -> pa.RecordBatch:
        conv, paths, begun = made["first"]
        last = made.get("last")
        ending = best_paths(model, lines_of(last[1]), True) if last else None
        return pa.RecordBatch.from_pydict({
            "part": [part], "first": [conv], "paths": [paths.ravel()], "begun": [begun.ravel()],
            "last": [last[0] if last else None], "ending": [None if ending is None else ending.ravel()], "single": [last is None],
        }, schema=END_SCHEMA)

    n = len(ROLES)
    found = in_parts(rows).mapInArrow(sum_up, "part int, first long, paths array<double>, begun array<double>, last long, ending array<double>, single boolean")
    parts = sorted(found.collect(), key=lambda r: r.part)  # one row per part
    ends: dict[int, tuple[np.ndarray | None, int | None]] = {}
    forward, chain, known, previous = None, [], False, None

    for r in parts:
        goes_on = known and previous == r.first
        ends[r.part] = (forward if goes_on else None, None)
        if not goes_on:
            fix_borders(chain, ends)
            chain = []
        paths = np.array(r.paths).reshape(n, n)
        after = (forward[:, None] + paths).max(axis=0) if goes_on else np.array(r.begun)
        chain.append((r.part, forward if goes_on else None, paths, after))
        if r.single:
            forward, previous = after, r.first
        else:
            fix_borders(chain, ends)  # the first conversation ends inside this part
            forward, previous = np.array(r.ending), r.last
            chain = [(r.part, None, paths, forward)]
        known = True
    fix_borders(chain, ends)
    return ends


def fix_borders(chain: list[tuple], ends: dict) -> None:
    """Fix the roles at the borders of the parts of one conversation, backwards from its free end.

    ``chain``: (part, scores before, best paths through the part, scores after) of each of its parts.
    """
    state = None
    for place in range(len(chain) - 1, -1, -1):
        part, before, paths, after = chain[place]
        if place < len(chain) - 1:
            ends[part] = (ends[part][0], state)
        state = int(after.argmax()) if state is None else state
        state = int((before + paths[:, state]).argmax()) if before is not None else state


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


TURNS = "conv_id long, turn long, piece int, role string, text string, rendered string, given string"


def parse(df: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, role, text, rendered, given): recovered turns; ``given`` is the table's own role, which is never used for it."""
    rows = ordered_rows(df)
    model = learn(rows)
    ends = part_ends(rows, model)

    def run(batches: Batches) -> Batches:
        waiting: list[tuple] = []
        for item in conversations(batches):
            if waiting:
                yield turns(*waiting[0], waiting[1], item[0] != waiting[0][0])
            waiting = [item, not waiting or item[0] != waiting[0][0]]
        if waiting:
            yield turns(*waiting[0], waiting[1], True)

    def turns(part: int, conv: int | None, held: list[dict], first: bool, last: bool) -> pa.RecordBatch:
        before, after = ends[part]
        roles = viterbi(model, lines_of(held), before if first else None, after if last else None)
        made, at = [], 0
        for row in held:
            lines = row["text"].split("\n")
            own = roles[at : at + len(lines)]
            at += len(lines)
            cuts = [0, *(i for i in range(1, len(lines)) if own[i] != own[i - 1]), len(lines)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                role, text = ROLES[own[a]], "\n".join([without_marker(lines[a]), *lines[a + 1 : b]]).strip()
                made.append((conv, row["turn"], piece, role, text, render(role, text), row["role"]))
        types = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4)
        names = ["conv_id", "turn", "piece", "role", "text", "rendered", "given"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    return in_parts(rows).mapInArrow(run, TURNS)
