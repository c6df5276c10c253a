"""Page extraction, transcripts and the pipeline."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedback_spark.llm import html_blocks, queries, transcripts

SMALL = "/root/testdata/sf0.001"


def plain_article(page):
    part = page[page.index("<article>") + 9 :]
    part = part[: min(i for i in (part.find("</article>"), part.find("<footer>"), len(part)) if i >= 0)]
    cut = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", part)]
    return "\n".join(x for x in cut if x)


def test_pages_give_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = queries.QUERIES["op2_html_blocks"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Home</a> Site</header>
<div class="cookie-banner">We use cookies <button>OK</button></div><article class="post"><header><h1>Head &amp; line</h1></header>
<p>One <a href=x>two</a>
 three.</p><div class="ad-slot">Buy now</div><ul><li>first<li>second <em>x</em>y</ul><script>if(a<b){"</p>"}</script>
<p>Last &eacute;&#233; para<br>line two</p><form><input name=q>Search</form></article><section id="comments"><p>A long comment of a reader
about all of it here</p></section><aside><p>Related story text that is long enough for a paragraph</p></aside><footer>c</footer>"""


def test_furniture_goes_and_blocks_stay():
    tree = html_blocks.train()
    assert html_blocks.main_text(PAGE, tree).split("\n") == ["Head & line", "One two three.", "first", "second xy", "Last éé para", "line two"]
    assert html_blocks.main_text("", tree) == "" and html_blocks.main_text("<<<> <p", tree) == ""


ARTICLE = "<article><h1>Head line</h1><p>" + "word " * 30 + "<p>Last one here</article>"
TEXT = ["Head line", ("word " * 30).strip(), "Last one here"]


@pytest.mark.parametrize("page", [
    "<html><head><title>t <b> u</title><meta charset=utf-8><body>" + ARTICLE,
    "<html><head><title>t</title><link rel=x href=y><noscript><img src=z></noscript>" + ARTICLE + "<footer>f</footer>",
    "<head><noscript><style>p{}</style><title>t</title><body><nav><a href=1>Home</a></nav>" + ARTICLE,
    "<HEAD><TITLE>t</TITLE></HEAD><BODY>" + ARTICLE + "</BODY>",
    *(f"<html><head></head><body><div><{n} id=q>inner</div>{ARTICLE}</body>" for n in ("button", "select", "object", "audio", "video", "canvas", "svg")),
    "<body><div><button>a</div>" + ARTICLE + "<div><button>b</button></div>",
    "<body><nav><ul><li><button>a<li><a href=1>b</a></ul></nav><video src=v>" + ARTICLE,
    *(f"<body><div class='{n}'>{ARTICLE}</div><footer>f</footer>" for n in ("content-sidebar-wrap", "no-sidebar", "with-comments")),
    "<body><main class=no-sidebar><div class=content-sidebar-wrap>" + ARTICLE + "</div></main>",
    "<body>" + ARTICLE + "<div class=related><article><p>" + "other " * 30 + "</article></div>",
    "<body><div class=content-sidebar-wrap>" + ARTICLE + "<div class=sidebar><article><p>" + "other " * 30 + "</article></div></div>",
    "<body>" + ARTICLE + "<ol class=comments><li><article class=comment-body><p>" + "other " * 30 + "</article></ol>",
])
def test_optional_tags_and_misleading_names(page):
    assert html_blocks.main_text(page, html_blocks.train()).split("\n") == TEXT


WHOLE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
WHOLE_RAW = re.compile(r"<!--.*?(?:-->|$)|<(script|style|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)", re.S | re.I)


def test_scan_equals_one_search_per_tag():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<a href=x>", "<", ">", '"', "'", "t ", "<!--", "-->", "<script>", "</script >", '<SCRIPT a="', "<b x='", "<!d", "<?", "\n", "</STYLE>", "<style"]
    for _ in range(20_000):
        page = "".join(rng.choices(bits, k=rng.randrange(20)))
        # A dollar sign also matches before a last line break, which is white space either way.
        assert html_blocks.without_raw(page).rstrip("\n") == WHOLE_RAW.sub(" ", page).rstrip("\n"), page
        wanted = [(m.start(), m.end(), m[1] == "/", (m[2] or "").lower()) for m in WHOLE_TAG.finditer(page)]
        assert [t[:4] for t in html_blocks.tags_of(page)] == wanted, page


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", '<script "', "<!", "<!--", "<title>", "<button>", "<ul><li>", "<span class=ad>"])
def test_long_broken_pages_take_time_by_their_length(part):
    start = time.process_time()
    html_blocks.blocks_of(part * (1_000_000 // len(part)))
    html_blocks.blocks_of("<div>" * 100_000 + "</p>" * 100_000)
    assert time.process_time() - start < 20


def without_marks(page):
    plain = re.sub(r"<(/?)(?:nav|article|footer|aside|section|header|main|form)\b", r"<\1div", page, flags=re.I)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", plain)


def test_text_is_found_without_tags_and_names(spark):
    """The given pages with sectioning tags, classes, ids and roles taken out: sizes, links and neighbours alone decide."""
    tree, kept, missed, added = html_blocks.train(), 0, 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        blocks = html_blocks.blocks_of(without_marks(r.html))
        assert not any(b.mark for b in blocks)
        wanted, got = [b.mark == 1 for b in html_blocks.blocks_of(r.html)], tree.predict(html_blocks.features(blocks)).tolist()
        kept += sum(a and b for a, b in zip(wanted, got))
        missed += sum(a and not b for a, b in zip(wanted, got))
        added += sum(b and not a for a, b in zip(wanted, got))
    assert kept / (kept + missed) > 0.98 and kept / (kept + added) > 0.98


def test_tree_splits_on_sizes_links_and_neighbours():
    def used(tree):
        return set() if tree.left is None else {html_blocks.FEATURES[tree.feature]} | used(tree.left) | used(tree.right)

    assert {"words", "links"} < used(html_blocks.train()) and used(html_blocks.train()) & {"words_before", "words_after", "links_before", "links_after"}


def test_tree_repeats_its_table():
    rows = html_blocks.training_rows()
    wrong = (html_blocks.train().predict(rows[:, :-1]) != (rows[:, -1] == 1)).sum()
    assert wrong <= len(rows) // 20


def test_extract_on_awkward_rows(frame):
    pages = frame("page_id long, html string, text string", (1, None, "old"), (2, "", "old"), (3, PAGE, "old"), (3, PAGE, "old"), (None, "<p>" + "word " * 50_000, "old"))
    made = html_blocks.extract(pages)
    rows = made.collect()
    assert made.columns == ["page_id", "html", "text"] and [r.text[:4] for r in rows] == ["", "", "Head", "Head", "word"]
    assert len(rows[4].text) == 5 * 50_000 - 1 and html_blocks.extract(pages.limit(0)).count() == 0


def transcript_rows(seed=1, turns=200):
    rng = random.Random(seed)
    rows = []
    for conv, n in [(1, 5), (2, 5), (7, turns), (9, 6), (10, 1)]:
        for i in range(n):
            role = ("user", "assistant")[i % 2]
            text = "\n".join("w " * rng.randrange(1, 20) for _ in range(rng.randrange(1, 2 + 3 * (i % 2)))) + rng.choice(["", "?"])
            rows.append((conv, i, role, text))
    rows[2] = (1, 2, "user", "a b\nUser: hi there\nAssistant: well\nok")
    return rows


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_roles_do_not_depend_on_parts(spark, frame, parts):
    rows = transcript_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame("conv_id long, turn long, role string, text string", *rows)
        model = transcripts.learn(transcripts.ordered_rows(df))
        made = transcripts.parse(df).orderBy("conv_id", "turn", "piece").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = []
    for conv in sorted({r[0] for r in rows}):
        own = [{"text": r[3]} for r in rows if r[0] == conv]
        roles, at = transcripts.viterbi(model, transcripts.lines_of(own)), 0
        for turn, row in enumerate(own):
            part = roles[at : at + row["text"].count("\n") + 1]
            at += len(part)
            wanted += [(conv, turn, k, transcripts.ROLES[part[i]]) for k, i in enumerate([0, *(i for i in range(1, len(part)) if part[i] != part[i - 1])])]
    assert [(r.conv_id, r.turn, r.piece, r.role) for r in made] == wanted


def test_markers_split_rows_and_leave_the_text(frame):
    text = "System: be brief\nUser: what is it?\nmore of it\nAssistant: this\n**Human:** thanks"
    rows = transcripts.parse(frame("conv_id long, turn long, text string", (1, 0, text))).orderBy("piece").collect()
    assert [(r.role, r.text) for r in rows] == [("system", "be brief"), ("user", "what is it?\nmore of it"), ("assistant", "this"), ("user", "thanks")]
    assert rows[0].rendered == "<|system|>\nbe brief\n<|end|>"


def test_transcripts_of_awkward_rows(frame):
    rows = [(1, 0, "user", None), (1, 0, "user", ""), (None, 1, None, "x"), (None, None, "odd", "y"), (2, 1, "user", "z " * 9000), (2, 1, "user", "z " * 9000)]
    df = frame("conv_id long, turn long, role string, text string", *rows)
    assert transcripts.parse(df).count() == len(rows) and transcripts.parse(df.limit(0)).count() == 0


def test_roles_are_recovered_on_the_held_out_fold(spark):
    made = queries.QUERIES["op4_transcripts"](spark, "/root/testdata/sf0.01").filter(~transcripts.training_fold()).filter("piece = 0")
    n, right = made.agg(F.count(F.lit(1)), F.sum(F.expr("cast(role = given as int)"))).first()
    assert n > 50 and right / n > 0.9


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    from feedback_spark.session import durable

    for name, stage in corpus_pipeline.STAGES:
        after = durable(stage(spark, docs, SMALL), name)
        assert name == "bpe" or after.columns == columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] and counts[1] < counts[0]
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]


def test_pipeline_encodes_and_decodes_in_stages_of_one_worker(spark, docs):
    # Two Python steps in one stage keep two workers per core, with all they hold, alive for the stages that follow.
    plan = corpus_pipeline.encoded(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_pipeline_on_awkward_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            made = stage(spark, given, SMALL)
            assert made.count() <= given.count() and (name == "bpe" or made.columns == given.columns)


WORKING_NAMES = """rest key node buckets label rep links first first_id first_key _key _first_id _first_key leaked _leaked host rate n_docs
    n_failed host_rate host_kept kept base_failed n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words score predicted toxic""".split()


def test_stages_pass_callers_columns_unchanged(spark):
    """Every working name of an operator may be a column of the caller."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in WORKING_NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in WORKING_NAMES), name


def test_pipeline_equals_plain_versions(spark):
    """Each stage against a plain version of its rule over what the stage before kept."""
    from test_documents_llm import plain_counts, plain_join
    from tokenizers import Tokenizer

    import public_tokenizers
    from feedback_spark.llm import host_rules, leak_search, toxicity

    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()

    counts = {d.doc_id: plain_counts(d.text) for d in docs}
    base = {i: c[0] < 10 or 100 * c[5] > 20 * c[0] for i, c in counts.items()}
    soft = {
        "symbols": {i: 100 * c[2] > 10 * c[1] for i, c in counts.items()},
        "lines": {i: 100 * c[4] > 30 * c[3] for i, c in counts.items()},
    }
    passed = [d for d in docs if not base[d.doc_id]]
    failed = {i: base[i] or any(s[i] for s in soft.values()) for i in counts}

    def rates(among, fails):
        hosts = {}
        for d in among:
            n, k = hosts.get(d.source, (0, 0))
            hosts[d.source] = n + 1, k + fails[d.doc_id]
        mean, weight = host_rules.prior(len(among), sum(k for _, k in hosts.values()), len(hosts), sum(k * k / n for n, k in hosts.values()))
        return {h: (k + mean * weight) / (n + weight) for h, (n, k) in hosts.items()}

    whole, by_rule = rates(docs, failed), {name: rates(passed, fails) for name, fails in soft.items()}
    docs = [
        d for d in passed if whole[d.source] < host_rules.HOST_LIMIT
        and not any(fails[d.doc_id] and by_rule[name][d.source] >= host_rules.SUSPECT_RATE for name, fails in soft.items())
    ]

    model = toxicity.learn(spark.createDataFrame(docs), labels)
    docs = [d for d, s in zip(docs, model.scores([d.text for d in docs])) if s < toxicity.THRESHOLD]

    classes = plain_join([(d.doc_id, d.text) for d in docs])
    docs = [d for d, (least, _) in zip(docs, classes) if d.doc_id == least]

    parts = [(*leak_search.question_and_answer(i.text), leak_search.words_of(i.text)) for i in items.collect()]

    def leaks(text):
        words, known = leak_search.words_of(text), {}
        return any(leak_search.is_leak(*(leak_search.overlap(p, words, known) for p in of_item)) for of_item in parts)

    docs = [d for d in docs if not leaks(d.text)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {d.doc_id: library.encode(d.text, add_special_tokens=False).ids for d in docs}
    made = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {i: r.ids for i, r in made.items()} == wanted
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in made.values())
