"""Exact lists of the most frequent values without a shuffle of all distinct values.

1. Each task keeps a mergeable summary of frequent items with at most ``tracked`` values; only summaries are shuffled. A
   summary of N rows names every value of more than ``ERROR`` / tracked * N rows, and its estimates are never too low.
2. The values it names are counted exactly in a second pass.
3. The list is complete when its last count is above what any value outside can have: the greater of that bound and the least
   estimate named. Otherwise the summary is widened; when the widest does not suffice, values are as good as all rare, and all are
   counted, which is a plain grouped count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedback_spark.session import durable

# Fixed value: rows a value may miss per row seen and value tracked, as published for the sketch that Spark uses.
ERROR = 3.5
TRACKED = (1 << 16, 1 << 20)
# Candidates named per place of the list.
SPARE = 20


def top_values(values: DataFrame, limit: int, tracked: tuple[int, ...] = TRACKED, column: str = "value") -> DataFrame:
    """(value, n) of the ``limit`` most frequent strings, ties by value."""
    ranked = lambda counted: counted.orderBy(F.desc("n"), column).limit(limit)
    values = values.filter(F.col(column).isNotNull())
    for size in tracked:
        asked = min(limit * SPARE, size * 3 // 4)
        summary = values.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{column}`, {asked}, {size})").alias("named")).first()
        if not summary.rows:
            break
        named = {r["item"]: r["count"] for r in summary.named}  # at most ``asked`` values
        if not named:
            continue
        outside = max(ERROR / size * summary.rows, min(named.values()) if len(named) == asked else 0)
        every = summary.rows * ERROR / size < 1 and len(named) < asked
        # Estimates are never too low, so no list can be proven whose last place is estimated at or below the bound.
        last = sorted(named.values())[-limit] if len(named) >= limit else 0
        if not every and last <= outside:
            continue
        listed = values.sparkSession.createDataFrame([(v,) for v in named], f"{column} string")
        exact = durable(ranked(values.join(F.broadcast(listed), column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))), "top_values")
        counts = [r.n for r in exact.collect()]
        if len(counts) == limit and counts[-1] > outside:
            return exact
        if every:
            # Nothing was dropped from the summary, so it named every value there is.
            return exact
    return ranked(values.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
