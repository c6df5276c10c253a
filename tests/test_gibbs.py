"""Topics by Gibbs sampling, and words that share a bucket."""

import random

import numpy as np

from catalog import plan_queries
from feedback_spark.operators import gibbs, topics


def planted(n=60, seed=4):
    """Documents of two kinds with words of their own and some common ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"{'ab'[i % 2]}{rng.randrange(12)}" for _ in range(rng.randrange(10, 30))]
        rows.append((i, sorted(own + rng.choices(["c0", "c1"], k=3))))
    return rows


def plain_fit(documents, k, used, burn_in, sweeps, thin, alpha, delta, seed):
    """The same sampler, one word at a time in plain Python."""
    def u(key, place, sweep):
        return float(gibbs.draw(np.array([key]), place, sweep, seed)[0])

    topic = {d: [min(int(u(d ^ (i << 20), 0, 0) * k), k - 1) for i in range(len(w))] for d, w in documents}
    beta, taken = np.zeros((k, used)), 0

    def counted():
        n = np.zeros((k, used))
        for d, w in documents:
            for x, t in zip(w, topic[d]):
                n[t, x] += 1
        return n

    for sweep in range(1, burn_in + sweeps + 1):
        n = counted()
        for d, w in documents:
            z, own = topic[d], [topic[d].count(t) for t in range(k)]
            for i, x in enumerate(w):
                was = z[i]
                own[was] -= 1
                weights = [(n[t, x] - (t == was) + delta) / (n[t].sum() - (t == was) + used * delta) * (own[t] + alpha) for t in range(k)]
                reach = np.cumsum(weights)
                z[i] = min(int((reach <= u(d, i, sweep) * reach[-1]).sum()), k - 1)
                own[z[i]] += 1
        if sweep > burn_in and (sweep - burn_in) % thin == 0:
            m = counted()
            beta += (m + delta) / (m.sum(axis=1, keepdims=True) + used * delta)
            taken += 1
    return beta / taken, topic


def test_sampler_equals_a_plain_one_on_any_partitioning(frame):
    rng = random.Random(1)
    documents = [(i, [rng.randrange(9) for _ in range(rng.randrange(12))]) for i in range(25)]
    options = {"burn_in": 1, "sweeps": 2, "thin": 1, "alpha": 0.5, "delta": 0.1, "seed": 7}
    want, topic = plain_fit(documents, 3, 9, **options)
    for parts in (1, 8):
        made = gibbs.fit(frame("key long, words array<int>", *documents).repartition(parts), 3, 9, **options)
        assert np.allclose(made.beta, want, atol=1e-12)
        assert {r.key: r.topics for r in made.state.collect()} == topic


def test_sweeps_kept_and_stored_equal_a_plain_sampler(frame, monkeypatch):
    """Topics stored after every second sweep and kept between, documents from no to ninety words."""
    monkeypatch.setattr(gibbs, "STORED_EACH", 2)
    rng = random.Random(8)
    documents = [(i, [rng.randrange(9) for _ in range(rng.randrange(10 if i < 20 else 90))]) for i in range(30)]
    options = {"burn_in": 2, "sweeps": 3, "thin": 1, "alpha": 0.5, "delta": 0.1, "seed": 7}
    want, topic = plain_fit(documents, 3, 9, **options)
    made = gibbs.fit(frame("key long, words array<int>", *documents).repartition(3), 3, 9, **options)
    assert np.allclose(made.beta, want, atol=1e-12)
    assert {r.key: r.topics for r in made.state.collect()} == topic


def test_query_makes_all_sweeps(spark, frame, monkeypatch):
    """200 thrown away, then 500, of which each fifth counts."""
    texts = [(i, f"apple pear {'plum' if i % 2 else 'fig'}es", 3) for i in range(6)]
    monkeypatch.setattr(plan_queries.base, "cleaned", lambda *_: frame("doc_id long, cleaned_text string, word_count int", *texts))
    asked, fit = [], gibbs.fit

    def fewer(*args, burn_in=gibbs.BURN_IN, sweeps=gibbs.SWEEPS, thin=gibbs.THIN, **rest):
        asked.append((burn_in, sweeps, thin))
        return fit(*args, burn_in=1, sweeps=1, thin=1, **rest)

    monkeypatch.setattr(gibbs, "fit", fewer)
    assert {r.term for r in plan_queries.gibbs_topics(spark, "").collect()} == {"apple", "pear", "plumes", "figes"}
    assert asked == [(200, 500, 5)]


def test_planted_topics_are_recovered(frame):
    lists = frame("doc_id long, terms array<string>", *planted()).coalesce(1)
    made = topics.gibbs_beta(lists, 2, limit=6, burn_in=14, sweeps=2, thin=2, alpha=0.2).collect()
    kinds = {t: {r.term[0] for r in made if r.topic == t} - {"c"} for t in (1, 2)}
    assert sorted(map(sorted, kinds.values())) == [["a"], ["b"]]
    assert all(sum(r.beta for r in made if r.topic == t) <= 1 for t in (1, 2))


def test_words_of_one_bucket_are_both_reported(frame):
    """With one bucket per topic word pair, its weight is split by the words' own counts."""
    lists = frame("doc_id long, terms array<string>", *planted())
    few = 4
    found = topics.gibbs_beta(lists, 2, limit=26, buckets=few, burn_in=1, sweeps=1, thin=1).collect()
    assert {r.term for r in found} == {t for _, terms in planted() for t in terms}
    for topic in (1, 2):
        assert abs(sum(r.beta for r in found if r.topic == topic) - 1) < 1e-9


def test_shares_split_by_weighted_counts(frame):
    lists = frame("doc_id long, terms array<string>", (1, ["x", "x", "y"]), (2, ["y"]))
    shares = frame("doc_id long, shares array<double>", (1, [0.75, 0.25]), (2, [0.5, 0.5]))
    weights = topics.term_weights(lists, shares, ["0"], 1)
    made = {(r.topic, r.term): r.beta for r in topics.split_beta([(1, "0", 0.8), (2, "0", 0.6)], weights).collect()}
    want = {(1, "x"): 0.8 * 1.5 / 2.75, (1, "y"): 0.8 * 1.25 / 2.75, (2, "x"): 0.6 * 0.5 / 1.25, (2, "y"): 0.6 * 0.75 / 1.25}
    assert made.keys() == want.keys() and all(abs(made[k] - want[k]) < 1e-9 for k in want)


def test_no_topics_of_too_few_documents(frame):
    lists = frame("doc_id long, terms array<string>", (1, ["x"]), (2, ["y"]))
    assert topics.gibbs_beta(lists, 3) is None and topics.gibbs_beta(lists.limit(0), 3) is None
