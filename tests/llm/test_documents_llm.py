"""Quality rules, near duplicates, leaks, toxicity and shards against plain versions."""

import itertools
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_spark.llm import bin_packing, components, host_rules, leak_search, ngram_join, queries, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)


def test_text_counts_match_a_plain_version():
    rng = random.Random(1)
    pool = ["a", "b", "cc", "é", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "|", "a b a b a b ", "x y z u v w "]
    for _ in range(2000):
        text = "".join(rng.choices(pool, k=rng.randrange(40)))
        assert host_rules.text_counts(text) == plain_counts(text), repr(text)


def test_judge_on_awkward_rows(docs, no_docs):
    made = host_rules.judge(docs)
    rows = made.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(made.columns)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert host_rules.judge(no_docs).count() == 0


def test_clashing_names_are_replaced(docs):
    odd = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("host", F.col("source"))
    assert {r.kept for r in host_rules.judge(odd, "host").select("kept").collect()} <= {True, False}


def test_hosts_are_shrunk_and_rejected(frame):
    good, bad = " ".join(f"w{i}" for i in range(30)), "no"
    rows = [(i, good, "good") for i in range(200)] + [(i, bad, "bad") for i in range(199)] + [(1000, good, "bad"), (1001, bad, "tiny"), (1002, good, "tiny"), (1003, good, None)]
    made = {(r.doc_id, r.source): r for r in host_rules.judge(frame("doc_id long, text string, source string", *rows)).collect()}
    assert not made[1000, "bad"].kept and not made[1000, "bad"].base_failed
    assert made[5, "good"].kept and made[1003, None].kept
    assert 0 < made[5, "good"].host_rate < 0.1 and made[1002, "tiny"].host_rate != 0.5


def test_soft_failures_count_only_on_hosts_where_they_are_common(frame):
    good = " ".join(f"w{i}" for i in range(30))
    noisy, twice = good + " " + "#$%&" * 20, "\n".join([good, "a line", "a line", "a line"])
    rows = [(i, good, "clean") for i in range(300)] + [(i, noisy, "spam") for i in range(100)] + [(i, good, "spam") for i in range(100, 300)]
    rows += [(900, noisy, "clean"), (901, twice, "clean"), (902, twice, "spam"), (903, noisy, "tiny"), (904, "no", "failing")]
    made = {(r.doc_id, r.source): r.kept for r in host_rules.judge(frame("doc_id long, text string, source string", *rows)).collect()}
    assert made[900, "clean"] and not made[5, "spam"] and made[200, "spam"]
    # Repeated lines are rare on every host; a host of one document is judged by what is usual elsewhere.
    assert made[901, "clean"] and made[902, "spam"] and not made[903, "tiny"] and not made[904, "failing"]


def test_host_verdicts_change_the_given_table(spark):
    """Documents that only fail the symbol rule go, and nearly all that are labelled are labelled bad."""
    sf = "/root/testdata/sf0.1"
    made = queries.QUERIES["op5_host_rules"](spark, sf).filter("NOT base_failed AND NOT kept")
    labels = [r.quality for r in made.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()]
    assert len(labels) > 200 and sum(labels) <= 0.01 * len(labels)


def test_prior_falls_back_without_spread():
    assert host_rules.prior(100, 10, 5, 100 * 0.01)[1] == host_rules.MOST_PRIOR


def shingle_set(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_join(rows):
    """(class id, links) of each row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    return [(min((x for x in ids[root(i)] if x is not None), default=None), n) for i, n in enumerate(links)]


def near_rows(n_families=6, size=40, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows) + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(60)]


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates_equal_all_pairs(frame, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    rows = near_rows()
    random.Random(3).shuffle(rows)
    rows += [rows[0], rows[0], (9000, rows[1][1]), (9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "one two"), (9006, "one")]
    made = ngram_join.near_duplicates(frame("doc_id long, text string", *rows))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in made.collect())
    assert got == Counter((d, *c) for (d, _), c in zip(rows, plain_join(rows)))


def test_edges_of_a_group_of_near_copies_grow_with_its_nodes():
    """A unit across two blocks passes on one edge however many links it finds, and all links are counted."""
    base = np.arange(1, 101, dtype=np.uint64)
    held = [(i, 1, i % 2, np.unique(np.append(base, np.uint64(1000 + i)))) for i in range(40)]
    inner = ngram_join.compare([h for h in held if h[2] == 0], False, 0.8).to_pylist()
    across = ngram_join.compare(held, True, 0.8).to_pylist()
    assert sum(r["b"] is not None for r in inner) == 19 and sum(r["b"] is not None for r in across) == 1
    assert {r["links"] for r in inner if r["b"] is None} == {19} and {r["links"] for r in across if r["b"] is None} == {20}


def test_candidates_of_near_copies_are_about_one_edge_a_node(frame):
    signed = frame(
        "node long, buckets array<long>",
        *[(n, [100 * band + (n + 3 * band) % 7 for band in range(12)]) for n in range(1, 201)], (900, [7000]), (901, [7000]), (None, None),
    )
    edges = {(r.a, r.b) for r in ngram_join.candidate_edges(signed).collect()}
    # One edge for each node and band were some 2,300; all are linked still.
    assert len(edges) < 300
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    # Each bucket holds the numbers of one remainder, so the seven remainders are seven groups at most.
    plain = {n: n for n in label}
    for band in range(12):
        for first in range(7):
            held = [n for n in range(1, 201) if (n + 3 * band) % 7 == first]
            least = min(plain[n] for n in held)
            plain.update({n: least for n in held})
    plain.update({900: 900, 901: 900})
    assert label == plain


def test_near_duplicates_of_null_ids_and_empty_table(frame, docs, no_docs):
    made = ngram_join.near_duplicates(frame("doc_id long, text string", (None, "a b c d e f"), (None, "a b c d e f"), (3, "x y z"))).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in made) == Counter([(None, None, 1), (None, None, 1), (3, 3, 0)])
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert ngram_join.near_duplicates(docs).count() == docs.count()


def test_keep_one_per_class(frame):
    rows = [(5, "a b c d e f", "p"), (5, "a b c d e f", "q"), (7, "a b c d e f", "r"), (5, "other words stand in this row", "s"), (8, None, "t"), (8, None, "t")]
    kept = ngram_join.keep_one(frame("doc_id long, text string, node string", *rows))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(5, "a b c d e f"), (5, "other words stand in this row"), (8, ""), (8, "")]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.999999)
    assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999999
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.999999, 4)


def test_components_of_a_chain_and_a_star(frame):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in components.components(frame("a long, b long", *edges)).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def bm25(index, words):
    """Scores of all items over all passages, term by term."""
    best = {}
    for start in range(0, max(1, len(words) - leak_search.PIECE_WORDS), leak_search.PIECE_WORDS):
        terms = {index.terms[w] for w in words[start : start + 2 * leak_search.PIECE_WORDS] if w in index.terms}
        total = Counter()
        for t in terms:
            for k in range(index.starts[t], index.starts[t + 1]):
                total[int(index.piece[k])] += float(index.weight[k])
        for piece, value in total.items():
            item = int(index.item_of[piece])
            if value >= leak_search.THRESHOLD - 1e-9:
                best[item] = max(best.get(item, 0), value)
    return best


def test_pruned_search_equals_the_full_scan(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items.append((999, " ".join(f"long{i}" for i in range(200))))
    index = next(leak_search.indexes(spark.createDataFrame(items, "item_id long, text string")))
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [items[-1][1], ""]
    for _ in range(60):
        words = items[rng.randrange(200)][1].split()
        texts.append(" ".join(rng.sample(words, len(words) * rng.randrange(3, 10) // 10)) + " " + " ".join(texts[rng.randrange(50)].split()[: rng.randrange(300)]))
    cut = list(map(leak_search.words_of, texts))
    for words, found in zip(cut, index.retrieve(cut)):
        wanted = bm25(index, words)
        assert set(found) == set(wanted) and all(abs(found[i] - wanted[i]) < 1e-9 for i in found)


def test_leaks_are_verified_and_dropped(frame, docs, no_docs):
    question = "which river flows through the old town of the northern province. The answer is the silver brook."
    items = frame("item_id long, text string", (1, question), (2, None), (3, ""), (1, question), (None, "quite another item of seven distinct words"))
    texts = frame("doc_id long, text string, _leaked string", (1, "Before. " + question.upper() + " after", "x"),
                  (2, "nothing of it here", "x"), (3, None, "x"), (4, "which river flows through the old town of the northern province and nothing more", "x"),
                  (5, "quite another item of seven distinct words", "x"))
    found = leak_search.leaks(texts, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in found if r.leaked) == Counter([(1, 1), (1, 1), (5, None)])
    assert sorted(r.doc_id for r in leak_search.without_leaks(texts, items).collect()) == [2, 3, 4]
    assert leak_search.leaks(no_docs, items).count() == 0 and leak_search.leaks(docs, items.limit(0)).count() == 0
    assert leak_search.without_leaks(docs, items).count() == docs.count()


def test_index_parts_find_the_same(spark):
    items, docs = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("benchmark", "documents"))
    texts = [r.text for r in docs.collect()]
    whole = next(leak_search.indexes(items))
    one = {(t, whole.items[i][0], round(s, 9)) for t, f in enumerate(whole.search(texts)) for i, s, _, _ in f}
    parts = list(leak_search.indexes(items, 2_000))
    assert len(parts) > 1
    assert one == {(t, p.items[i][0], round(s, 9)) for p in parts for t, f in enumerate(p.search(texts)) for i, s, _, _ in f}


def test_every_planted_item_is_found(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_leak_search"](spark, SMALL).filter("leaked").collect()}
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= found


def test_cut_and_edited_items_are_leaks(spark, frame):
    """Items cut short, with one word replaced, or in pieces too far apart for one passage; counts against plain triples."""
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    rng, rows = random.Random(8), []
    for i in items:
        words = i.text.split()
        edited = list(words)
        edited[rng.randrange(len(words))] = "replaced"
        apart = " ".join(" ".join(words[k : k + 12]) + " filler" * 150 for k in range(0, len(words), 12))
        rows += [(i.item_id, " ".join(t)) for t in (words[:-3], words[: len(words) * 9 // 10], edited, words[: len(words) // 2])] + [(i.item_id, apart)]
    texts, wanted = frame("doc_id long, text string", *rows), Counter()
    for k, (item, text) in enumerate(rows):
        held = leak_search.tuples(leak_search.words_of(text), 3)
        whole = leak_search.tuples(leak_search.words_of(next(i.text for i in items if i.item_id == item)), 3)
        if len(held & whole) > 0.6 * len(whole):
            wanted[item] += 1
        assert k % 5 > 2 or len(held & whole) > 0.6 * len(whole)
    found = leak_search.leaks(texts, spark.createDataFrame(items)).filter("leaked").collect()
    counts = Counter((r.doc_id, r.item_id) for r in found)
    assert all(counts[i, i] >= n for i, n in wanted.items()) and any(r.score < leak_search.THRESHOLD for r in found)
    assert leak_search.without_leaks(texts, spark.createDataFrame(items)).count() <= len(rows) - sum(wanted.values())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        after = [i + 1]
        for j, y in enumerate(b):
            after.append(min(after[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = after
    return row[-1]


def test_automaton_equals_edit_distance():
    words, beginnings = ["idiot", "moron", "scum", "disgusting", "pathetic", "clown"], ["réeu", "boco"]
    automaton = toxicity.Automaton(words, beginnings)
    rng, tokens = random.Random(6), set()
    for _ in range(5000):
        word = list(rng.choice(words + beginnings))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", *"abcdeiostué1"])
        tokens.add("".join(word))
    found = automaton.matches(list(tokens))
    for t in tokens:
        near = [edits(t, w) for w in words if edits(t, w) <= toxicity.edits_for(w)] + [0 for b in beginnings if t.startswith(b)]
        assert found.get(t) == (min(near) if near else None), t


def test_quotation_is_told_from_abuse():
    model = toxicity.Model(toxicity.Automaton(["idiot"], []), toxicity.FALLBACK)
    abuse, spelled, quoted, reported, clean, empty = model.scores(
        ["you are an idiot", "such an idi0t here", 'the word "idiot" is old', "they said idiot", "a kind word", ""]
    ).tolist()
    assert abuse > 0.3 and spelled > 0.3 and max(quoted, reported) < 0.3 and clean == empty == quoted


def test_only_paired_marks_and_verbs_of_the_clause_take_a_match_back():
    model = toxicity.Model(toxicity.Automaton(["idiot"], []), toxicity.FALLBACK)
    abusive = ['"Hi" you idiot "bye"', "he called. you idiot", "she wrote code; you idiot", 'an open " you idiot', "« a » you idiot « b »"]
    harmless = ['“you idiot” is rude', "they wrote: idiot", "« idiot »", '"one" and "idiot"']
    assert min(model.scores(abusive)) > 0.3 > max(model.scores(harmless))
    assert toxicity.quoted_places(['"', "a", "\n", "b", '"', "c", '"']) == {5}


def test_large_lexicon_is_built_at_once_and_kept_small(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(8, 12))) for _ in range(5_000)]
    start = time.perf_counter()
    automaton = toxicity.Automaton(words, [])
    assert time.perf_counter() - start < 2 and len(automaton.states) == 2
    asked = [w[:3] + "x" + w[4:] for w in words[:300]] + ["zzqqj" * 3]
    found = automaton.matches(asked)
    assert all(w in found for w in asked[:300]) and asked[-1] not in found
    sent = pickle.loads(pickle.dumps(automaton))
    assert len(sent.states) == 2
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 16)
    monkeypatch.setattr(toxicity, "MOST_CELLS", 1)
    assert sent.matches(asked) == found


def plain_entries(rows):
    """(words, beginnings) by the rule, one term after another."""
    words, starts = ({t: n for t, b, n in rows if b == begins} for begins in (False, True))
    shortest = [s for s in starts if not any(s[:k] in starts for k in range(1, len(s)))]
    beginnings = {s for s in shortest if not any(w.startswith(s) and n >= toxicity.ONE_WORD_SHARE * starts[s] for w, n in words.items())}
    return {w for w in words if not any(w.startswith(b) for b in beginnings)}, beginnings


def test_entries_equal_a_plain_choice(frame):
    rng, rows = random.Random(3), {}
    for _ in range(400):
        word = "".join(rng.choices("abé", k=rng.randrange(3, 10)))
        rows[word, False] = rng.randrange(5, 30)
        for k in toxicity.BEGINNINGS:
            if len(word) >= k and rng.random() < 0.3:
                rows[word[:k], True] = rng.randrange(5, 60)
    rows = [(t, b, n) for (t, b), n in rows.items()]
    made = toxicity.choose_entries(frame("term string, begins boolean, toxic long", *rows)).collect()
    assert len(made) == len(set(made))
    assert ({r.term for r in made if not r.begins}, {r.term for r in made if r.begins}) == plain_entries(rows)


def test_scores_of_awkward_rows(frame, docs, no_docs):
    labels = frame("doc_id long, quality int, toxic int", (1, 1, None), (None, 1, 1), (4, 1, 0), (4, 1, 0))
    model = toxicity.learn(docs, labels)
    made = toxicity.score(docs, model)
    assert made.columns == [*docs.columns, "score", "predicted"] and made.count() == docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert np.array_equal(toxicity.learn(no_docs, labels.limit(0)).weights, toxicity.FALLBACK)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    made = queries.QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made)
    right = sum(r.predicted == r.toxic for r in made) / len(made)
    found = sum(r.predicted for r in made if r.toxic) / sum(r.toxic for r in made)
    assert right > 0.97 and found > 0.85


def test_best_fit_takes_the_tightest_bin():
    assert bin_packing.best_fit_decreasing([7, 5, 4, 3, 2], 10) == [0, 1, 1, 0, 2]
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 100) for _ in range(500)), reverse=True)
    free, wanted = [], []
    for size in sizes:
        fits = [(room, b) for b, room in enumerate(free) if room >= size]
        if not fits:
            free.append(100)
            fits = [(100, len(free) - 1)]
        b = min(fits)[1]
        free[b] -= size
        wanted.append(b)
    assert bin_packing.best_fit_decreasing(sizes, 100) == wanted
    assert bin_packing.best_fit_decreasing(sizes, 100, max(wanted)) is None


def test_pack_gives_a_large_group_its_own_shard():
    placed = bin_packing.pack([900, *[10] * 60], 4)
    loads = Counter()
    for size, shard in zip([900, *[10] * 60], placed):
        loads[shard] += size
    assert loads == {0: 900, 1: 200, 2: 200, 3: 200}
    assert bin_packing.pack([], 4) == [] and bin_packing.pack([5, 3], 4) == [0, 1]


def test_shards(docs, no_docs):
    rows = bin_packing.shards(docs, 4).collect()
    assert len(rows) == docs.count() and bin_packing.shards(no_docs, 4).count() == 0
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    homes = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_shard_query_is_even(spark):
    rows = queries.QUERIES["op3_bin_packing"](spark, SMALL).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert set(loads) == set(range(16)) and max(loads.values()) < 1.2 * min(loads.values())
