"""Quality rules of documents and verdicts on their hosts.

1. Each document's counts are taken once over its whole text, in its own partition;
   the text is not shuffled.
2. Failures are summed by host, of all rules together and of each soft rule among the
   documents that pass the base rules. A host with a third of all documents is summed
   in every task before its partial sums meet.
3. Failure rates are shrunk towards all hosts: a beta prior is fitted to the hosts'
   rates by moments, and a host's rate is the mean of its posterior. A host of few
   documents therefore needs more evidence than a large one.
4. A host whose shrunk rate of all rules reaches ``HOST_LIMIT`` is rejected with all its
   documents. A soft rule (symbols, repeated lines) decides on a host's documents when
   its shrunk rate there reaches ``SUSPECT_RATE``; where it hardly ever fails, a failure
   is taken for an exception and forgiven. Verdicts, one row per host, are joined back.

Defined cases: null text has no words and fails; a null host is a host of its own; repeated rows
count and are returned one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import durable, texts_of, with_columns

# Fixed values of the rules.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
MOST_SYMBOL_PERCENT = 10
MOST_DUPLICATE_LINE_PERCENT = 30
# A host goes when most of its documents fail.
HOST_LIMIT = 0.5
# A soft rule counts on a host when this share of its otherwise good documents fails it.
SUSPECT_RATE = 0.02
# The fitted prior weighs as much as this many documents at least and at most.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers = dict.fromkeys(words)
    if len(numbers) == len(words):
        return 0
    for i, w in enumerate(numbers):
        numbers[w] = i
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    # Windows of 1, 2, 4 and then 5 words are numbered exactly, pair by pair.
    two = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    _, place, count = np.unique(four[:-1] * len(numbers) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """The values of COUNTS."""
    words = text.encode().split()  # cuts at exactly the white space of the word rule
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    blank = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), len(text) - blank, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def add_counts(df: DataFrame, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    names = [part.split()[0] for part in COUNTS.split(",")]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = np.array([text_counts(t) for t in texts_of(batch, text_column)], np.int64).reshape(-1, len(names))
        return {n: pa.array(rows[:, i]) for i, n in enumerate(names)}

    return with_columns(df, [text_column], COUNTS, work, drop=() if keep_text else (text_column,))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def soft_failures() -> dict[str, Column]:
    """The rules whose failure counts only on hosts where it is common."""
    return {
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > MOST_DUPLICATE_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(counted: DataFrame, host_column: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept) of every host, and per soft rule its rate and whether it counts there."""
    base, soft = base_failed(), soft_failures()
    any_failed = base
    for failed in soft.values():
        any_failed = any_failed | failed
    hosts = counted.groupBy(F.col(host_column).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(any_failed).alias("n_failed"),
        F.count_if(~base).alias("n_passed"),
        *[F.count_if(~base & failed).alias(f"n_{rule}") for rule, failed in soft.items()],
    )
    kinds = {"all": ("n_docs", "n_failed"), **{rule: ("n_passed", f"n_{rule}") for rule in soft}}
    sums = hosts.agg(*[  # one row
        F.struct(
            F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.count_if(F.col(n) > 0).alias("hosts"),
            F.sum(F.when(F.col(n) > 0, F.col(k) * F.col(k) / F.col(n))).alias("squares"),
        ).alias(kind)
        for kind, (n, k) in kinds.items()
    ]).first()
    rates = {kind: shrunk(F.col(n), F.col(k), sums[kind]) for kind, (n, k) in kinds.items()}
    return hosts.select(
        "host", "n_docs", "n_failed", rates["all"].alias("rate"), (rates["all"] < HOST_LIMIT).alias("host_kept"),
        *[c for rule in soft for c in (rates[rule].alias(f"{rule}_rate"), (rates[rule] >= SUSPECT_RATE).alias(f"{rule}_count"))],
    )


def shrunk(n: Column, k: Column, sums) -> Column:
    """Posterior mean of a host's failure rate; 0 where no document of any host can fail."""
    if not sums.docs:
        return F.lit(0.0)
    mean, strength = prior(sums.docs, sums.failed, sums.hosts, sums.squares)
    return (k + F.lit(mean * strength)) / (n + F.lit(strength))


def prior(docs: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and weight of the beta prior: the spread of the hosts' rates less what chance alone would give."""
    mean = failed / docs
    spread = mean * (1 - mean)
    between = squares / docs - mean * mean - hosts * spread / docs
    strength = spread / between - 1 if between > 0 else MOST_PRIOR
    return mean, min(max(strength, LEAST_PRIOR), MOST_PRIOR)


def judge(df: DataFrame, host_column: str = "source", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with counts, ``base_failed``, ``host_rate`` and ``kept``. Without texts only narrow rows are stored."""
    counted = add_counts(df, text_column, keep_text)
    counted = durable(counted, "rule_counts")
    # Stored, so that its size is known before the join: few hosts are broadcast, many are joined by a shuffle.
    found = durable(host_verdicts(counted, host_column), "hosts")
    # One column besides the host, so that few names can clash.
    verdict = F.struct(F.col("rate"), "host_kept", *[f"{rule}_count" for rule in soft_failures()]).alias("host_verdict")
    hosts = found.select("host", verdict)
    taken = ("base_failed", "kept", "host_rate", "host_verdict", "host")
    plain = counted.drop(*[c for c in taken if c != host_column])
    joined = plain.join(hosts, plain[host_column].eqNullSafe(hosts["host"]))
    failed = base_failed()
    kept = ~failed & F.col("host_verdict.host_kept")
    for rule, failure in soft_failures().items():
        kept = kept & ~(failure & F.col(f"host_verdict.{rule}_count"))
    out = joined.withColumn("base_failed", failed).withColumn("kept", kept).withColumn("host_rate", F.col("host_verdict.rate"))
    out = out.drop("host_verdict")
    return out if host_column == "host" else out.drop("host")
