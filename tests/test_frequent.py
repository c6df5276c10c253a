"""Exact top lists from mergeable summaries."""

from collections import Counter

import numpy as np
import pytest

from feedback_spark.operators import frequent


def plain(values, limit):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda t: (-t[1], t[0]))[:limit]


@pytest.mark.parametrize("tracked", [(64,), (64, 1024), (1 << 16,)])
@pytest.mark.parametrize("kind", ["skewed", "flat"])
def test_list_equals_a_full_count(spark, frame, tracked, kind):
    rng = np.random.default_rng(3)
    numbers = rng.zipf(1.3, 6000) if kind == "skewed" else rng.integers(0, 3000, 6000)
    values = [f"v{n % 5000}" for n in numbers] + [None, None]
    made = frequent.top_values(frame("value string", *[(v,) for v in values]).repartition(5), 10, tracked)
    assert sorted([(r.value, r.n) for r in made.collect()], key=lambda t: (-t[1], t[0])) == plain(values, 10)


def test_proven_list_counts_only_named_values(spark, frame):
    values = [f"v{i % 5}" for i in range(5000)] + [f"rare{i}" for i in range(2000)]
    made = frequent.top_values(frame("value string", *[(v,) for v in values]), 3, (4096,))
    assert [(r.value, r.n) for r in made.orderBy("value").collect()] == [("v0", 1000), ("v1", 1000), ("v2", 1000)]
    assert "csv" not in made._jdf.queryExecution().toString() and "top_values" in made.inputFiles()[0]


def test_short_and_empty_inputs(frame):
    assert frequent.top_values(frame("value string"), 3).count() == 0
    made = frequent.top_values(frame("value string", ("a",), ("a",), ("b",), (None,)), 30).collect()
    assert sorted((r.value, r.n) for r in made) == [("a", 2), ("b", 1)]
