"""Documents: cleaning, words, lexicon scores, emotions, keywords, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import query
from feedback_spark.functions import labels, text
from feedback_spark.functions.numbers import round_half_even
from feedback_spark.operators import cleaning, emotions, entries, keywords, polarity, tokens, topics, word_hits
from feedback_spark.plans import insights
from feedback_spark.session import durable

# Length of the long keyword list, a top list.
LONG_LIST = 2_000


def _words(spark, sf):
    return tokens.tokens(base.cleaned(spark, sf))


def _counts(spark, sf):
    return keywords.word_counts(tokens.words_only(base.cleaned(spark, sf)))


def _scored(spark, sf):
    lists = base.lexicons(spark)
    return polarity.hybrid_polarity(base.cleaned(spark, sf), lists.polarity, lists.weights, lists.shifters)


# ---- cleaning --------------------------------------------------------------

@query("build_documents", "SELECT doc_id, raw_text, label FROM built")
def build_documents(spark, sf):
    return cleaning.build_documents(
        base.feedback(spark, sf), "text", key="doc_id", labelled=True, label_column="label"
    )


@query("normalise_label", """SELECT doc_id, label AS typed, CASE WHEN label IS NULL OR label = '' THEN 'neutral'
    WHEN lower(trim(label)) IN ('pos', 'positive') THEN 'pos' WHEN lower(trim(label)) IN ('neg', 'negative') THEN 'neg'
    ELSE lower(trim(label)) END AS label FROM feedback""")
def normalise_label(spark, sf):
    label = labels.normalise_label(F.col("label"), F.lit(True))
    return base.feedback(spark, sf).select("doc_id", F.col("label").alias("typed"), label.alias("label"))


@query("label_category", """SELECT doc_id, CASE label WHEN 'pos' THEN 'Positive' WHEN 'neg' THEN 'Negative'
    WHEN 'neutral' THEN 'Neutral' ELSE 'Unknown' END AS doc_category FROM built""")
def label_category(spark, sf):
    return build_documents(spark, sf).select("doc_id", labels.label_category(F.col("label")).alias("doc_category"))


@query("drop_empty_text", f"""SELECT doc_id, length(raw_text) AS chars FROM (
    SELECT doc_id, {base.strip_sql('text')} AS raw_text FROM documents) WHERE raw_text IS NOT NULL AND length(raw_text) > 0""")
def drop_empty_text(spark, sf):
    raw = base.documents(spark, sf).select("doc_id", text.strip(F.col("text")).alias("raw_text"))
    return cleaning.drop_empty_text(raw).select("doc_id", F.length("raw_text").cast("long").alias("chars"))


@query("clean_text", "SELECT doc_id, cleaned_text FROM clean")
def clean_text(spark, sf):
    return base.cleaned(spark, sf).select("doc_id", "cleaned_text")


@query("clean_pages", f"SELECT page_id, {base.clean_sql('html')} AS cleaned_text FROM pages")
def clean_pages(spark, sf):
    pages = base.table(spark, sf, "pages")
    return pages.select("page_id", text.clean_text(F.col("html")).alias("cleaned_text"))


@query("word_count", "SELECT doc_id, len(string_split(cleaned_text, ' ')) AS word_count FROM clean")
def word_count(spark, sf):
    return base.cleaned(spark, sf).select("doc_id", "word_count")


# ---- words and lexicon scores ----------------------------------------------

@query("tokens", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM tok")
def tokens_(spark, sf):
    return _words(spark, sf)


@query("bigrams", """SELECT doc_id, word AS w1, next AS w2 FROM (
    SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok) WHERE next IS NOT NULL""")
def bigrams(spark, sf):
    return tokens.bigrams(base.cleaned(spark, sf))


@query("bing_hits", "SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, sentiment FROM hits")
def bing_hits(spark, sf):
    return polarity.bing_hits(_words(spark, sf), base.lexicons(spark).polarity)


@query("emotion_hits", """SELECT t.doc_id, CAST(t.pos AS INTEGER) AS pos, t.word, e.sentiment AS emotion
    FROM tok t JOIN emolex e ON t.word = e.word WHERE e.sentiment NOT IN ('positive', 'negative')""")
def emotion_hits(spark, sf):
    return emotions.emotion_hits(_words(spark, sf), base.lexicons(spark).emotions)


@query("lexicon_counts", "SELECT doc_id, sentiment, count(*) AS n FROM hits GROUP BY doc_id, sentiment")
def lexicon_counts(spark, sf):
    return polarity.lexicon_counts(_words(spark, sf), base.lexicons(spark).polarity)


@query("lexicon_pivot", "SELECT doc_id, positive, negative FROM pn")
def lexicon_pivot(spark, sf):
    return polarity.lexicon_pivot(lexicon_counts(spark, sf))


@query("bing_score", "SELECT doc_id, (positive - negative)::DOUBLE / (positive + negative + 1) AS bing_score FROM pn")
def bing_score(spark, sf):
    score = polarity.bing_score(F.col("positive"), F.col("negative"))
    return lexicon_pivot(spark, sf).select("doc_id", score.alias("bing_score"))


@query("valence_score", f"SELECT doc_id, {base.half_even('valence_score', 9)} AS valence_score FROM valence")
def valence_score(spark, sf):
    return _scored(spark, sf).select("doc_id", round_half_even(F.col("valence_score"), 9).alias("valence_score"))


@query("hybrid_polarity", f"""SELECT doc_id, word_count, positive, negative,
    {base.half_even('polarity_score', 9)} AS polarity_score, polarity_class FROM scored""")
def hybrid_polarity(spark, sf):
    score = round_half_even(F.col("polarity_score"), 9).alias("polarity_score")
    return _scored(spark, sf).select("doc_id", "word_count", "positive", "negative", score, "polarity_class")


@query("polarity_class", f"""SELECT doc_id, {base.level_sql('score')} AS polarity_class FROM (
    SELECT doc_id, (n_chars % 41 - 20)::DOUBLE / 100 AS score FROM documents)""")
def polarity_class(spark, sf):
    """On scores in steps of 0.01, so that every limit is met exactly."""
    score = (F.col("n_chars") % 41 - 20).cast("double") / 100
    return base.table(spark, sf, "documents").select("doc_id", labels.polarity_class(score).alias("polarity_class"))


@query("corpus_summary", f"""SELECT count(*) AS documents, CAST(round_even(avg(word_count), 0) AS BIGINT) AS avg_word_count,
    {base.half_even("(100.0::DOUBLE * count(*) FILTER (polarity_class IN ('Very Positive', 'Positive')) / count(*))", 1)} AS positive_pct,
    {base.half_even("(100.0::DOUBLE * count(*) FILTER (polarity_class IN ('Very Negative', 'Negative')) / count(*))", 1)} AS negative_pct
    FROM scored""")
def corpus_summary(spark, sf):
    return polarity.corpus_summary(_scored(spark, sf))


@query("polarity_counts", f"""SELECT polarity_class AS polarity, count(*) AS n,
    {base.order_sql('polarity_class')}::BIGINT AS polarity_order FROM scored GROUP BY polarity_class""")
def polarity_counts(spark, sf):
    return polarity.polarity_counts(_scored(spark, sf))


@query("polarity_distribution", f"""SELECT l.polarity, count(s.doc_id) AS n FROM {base.LEVELS_SQL}
    LEFT JOIN scored s ON s.polarity_class = l.polarity GROUP BY l.polarity""")
def polarity_distribution(spark, sf):
    return polarity.polarity_distribution(_scored(spark, sf), "polarity_class")


# ---- emotions --------------------------------------------------------------

@query("emotion_shares", "SELECT emotion, n, pct FROM emo")
def emotion_shares(spark, sf):
    return emotions.emotion_shares(_counts(spark, sf), base.lexicons(spark).emotions)


@query("emotion_by_document", f"""SELECT doc_id, emotion, n,
    {base.half_even('(n::DOUBLE / sum(n) OVER (PARTITION BY doc_id))', 4)} AS share FROM (
    SELECT t.doc_id, e.sentiment AS emotion, count(*) AS n FROM tok t JOIN emolex e ON t.word = e.word
    WHERE e.sentiment NOT IN ('positive', 'negative') GROUP BY t.doc_id, e.sentiment)""")
def emotion_by_document(spark, sf):
    return emotions.emotion_by_document(_words(spark, sf), base.lexicons(spark).emotions)


@query("emotion_distribution", "SELECT emotion, share FROM emodist")
def emotion_distribution(spark, sf):
    return emotions.emotion_distribution(emotion_shares(spark, sf))


@query("emotion_percent", """SELECT CAST(o.pos AS INTEGER) AS place, o.label AS emotion, CAST(floor(coalesce(d.share, 0) * 100 + 0.5) AS BIGINT) AS pct
    FROM (VALUES (1, 'happiness', 'Joy'), (2, 'sadness', 'Sadness'), (3, 'anger', 'Anger'), (4, 'surprise', 'Surprise'),
    (5, 'fear', 'Fear'), (6, 'disgust', 'Disgust')) o(pos, key, label) LEFT JOIN emodist d ON d.emotion = o.key""")
def emotion_percent(spark, sf):
    return emotions.emotion_percent(emotion_distribution(spark, sf))


@query("entries_with_emotions", """SELECT d.doc_id, d.polarity, e.emotion, e.share FROM docentries d CROSS JOIN emodist e""")
def entries_with_emotions(spark, sf):
    """In long form: one row per document and emotion of the corpus map."""
    shared = emotions.emotions_map(emotion_distribution(spark, sf))
    made = entries.entries_with_emotions(base.document_entries(spark, sf).select("doc_id", "polarity"), shared)
    return made.select("doc_id", "polarity", F.explode("emotions").alias("emotion", "share"))


# ---- frequent words and keywords -------------------------------------------

@query("top_words", "SELECT word, n FROM topw")
def top_words(spark, sf):
    return keywords.top_words(_counts(spark, sf), base.lexicons(spark).stops)


@query("top_bigrams", """SELECT concat(word, ' ', next) AS bigram, word AS w1, next AS w2, n FROM (
    SELECT word, next, count(*) AS n FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok)
    WHERE length(word) > 2 AND length(next) > 2 AND word NOT IN (SELECT word FROM stops) AND next NOT IN (SELECT word FROM stops)
    GROUP BY word, next) ORDER BY n DESC, w1, w2 LIMIT 20""")
def top_bigrams(spark, sf):
    return keywords.top_bigrams(tokens.bigrams(base.cleaned(spark, sf)), base.lexicons(spark).stops)


def _hits(spark, sf, top=None):
    marked = keywords.keyword_marks(base.document_entries(spark, sf), top or top_words(spark, sf))
    return keywords.keyword_hits(marked, key="doc_id")


def _scores(spark, sf, top):
    """Keyword scores of a stored list of words, stored: a few rows that several parts read."""
    return durable(keywords.keyword_scores(_hits(spark, sf, top)), "keyword_scores")


def _shared(spark, sf):
    """(top words, emotions) from one count of the words, which is stored."""
    counts = durable(_counts(spark, sf), "word_counts")
    found = emotions.emotion_distribution(emotions.emotion_shares(counts, base.lexicons(spark).emotions))
    return durable(keywords.top_words(counts, base.lexicons(spark).stops), "top_words"), found


@query("keyword_hits", "SELECT CAST(rank AS INTEGER) AS rank, word, n, pos_hits, neg_hits, first_polarity FROM kwhits")
def keyword_hits(spark, sf):
    return _hits(spark, sf)


@query("keyword_hits_long", f"""SELECT k.rank::INTEGER AS rank, k.word, k.n,
    count(*) FILTER ({base.group_sql('d.polarity')} = 'positive' AND contains(lower(d.text), k.word)) AS pos_hits,
    count(*) FILTER ({base.group_sql('d.polarity')} = 'negative' AND contains(lower(d.text), k.word)) AS neg_hits,
    arg_min(d.polarity, d.doc_id) AS first_polarity
    FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM wc
        WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stops) ORDER BY n DESC, word LIMIT {LONG_LIST}) k
    CROSS JOIN docentries d GROUP BY k.rank, k.word, k.n""")
def keyword_hits_long(spark, sf):
    top = durable(keywords.top_words(_counts(spark, sf), base.lexicons(spark).stops, LONG_LIST), "long_list")
    return word_hits.keyword_hits(base.document_entries(spark, sf), top, key="doc_id")


@query("keyword_scores", "SELECT side, CAST(place AS INTEGER) AS place, word, score FROM kwscores")
def keyword_scores(spark, sf):
    return keywords.keyword_scores(_hits(spark, sf))


@query("word_cloud", """SELECT t.word, t.n::DOUBLE AS weight, p.word IS NOT NULL AS is_positive,
    t.n::DOUBLE / greatest(max(t.n) OVER (), 1) AS size
    FROM topw t LEFT JOIN (SELECT * FROM kwscores WHERE side = 'positive') p ON t.word = p.word""")
def word_cloud(spark, sf):
    top = durable(top_words(spark, sf), "top_words")
    return keywords.word_cloud(top, _scores(spark, sf, top))


@query("keyword_relative", """SELECT side, word, score,
    abs(score) / greatest(max(abs(score)) OVER (PARTITION BY side), 0.01::DOUBLE) AS relative FROM kwscores""")
def keyword_relative(spark, sf):
    return keywords.keyword_relative(keyword_scores(spark, sf))


@query("leading_terms", """SELECT side AS kind, word AS lead FROM kwscores WHERE place = 1 UNION ALL
    SELECT 'emotion', CASE emotion WHEN 'happiness' THEN 'Joy' WHEN 'sadness' THEN 'Sadness' WHEN 'anger' THEN 'Anger'
        WHEN 'surprise' THEN 'Surprise' WHEN 'fear' THEN 'Fear' WHEN 'disgust' THEN 'Disgust' ELSE emotion END
    FROM (SELECT emotion FROM emodist ORDER BY share DESC, emotion LIMIT 1)""")
def leading_terms(spark, sf):
    top, found = _shared(spark, sf)
    lead = insights.leading_emotion(found).select(F.lit("emotion").alias("kind"), F.col("emotion").alias("lead"))
    words = keywords.leading_keywords(_scores(spark, sf, top)).select(F.col("side").alias("kind"), F.col("word").alias("lead"))
    return words.unionByName(lead)


@query("result_presence", """SELECT 'keywords_positive' AS part, count(*) AS n FROM kwscores WHERE side = 'positive'
    UNION ALL SELECT 'keywords_negative', count(*) FROM kwscores WHERE side = 'negative'
    UNION ALL SELECT 'word_cloud', count(*) FROM topw
    UNION ALL SELECT 'emotions', count(*) FROM emodist""")
def result_presence(spark, sf):
    top, found = _shared(spark, sf)
    scores = _scores(spark, sf, top)
    return insights.result_presence(
        keywords_positive=scores.filter("side = 'positive'"), keywords_negative=scores.filter("side = 'negative'"),
        word_cloud=top, emotions=found,
    )


# ---- topics ----------------------------------------------------------------

@query("topic_tokens", """SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM tok WHERE length(word) > 2
    AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN (SELECT word FROM stops)""")
def topic_tokens(spark, sf):
    return tokens.topic_tokens(base.cleaned(spark, sf), base.lexicons(spark).stops)


@query("stemmed_tokens")
def stemmed_tokens(spark, sf):
    """Stems over whole texts; checked in the tests against the published examples."""
    return tokens.stemmed(topic_tokens(spark, sf)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("doc_term_counts", "SELECT doc_id, word, count(*) AS n FROM tok GROUP BY doc_id, word")
def doc_term_counts(spark, sf):
    return tokens.doc_term_counts(_words(spark, sf))


def _language_terms(spark, sf):
    """Words per language and their counts, as a table of topics with weights."""
    langs = base.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    words = tokens.tokens(tokens.by_document(base.cleaned(spark, sf)))
    counted = tokens.doc_term_counts(words).join(langs, "doc_id").groupBy("topic", F.col("word").alias("term"))
    return topics.top_terms_ties(counted.agg(F.sum("n").alias("beta")))


@query("top_terms_ties", "SELECT lang AS topic, term, CAST(n AS BIGINT) AS beta, CAST(place AS INTEGER) AS place FROM langterms WHERE place <= 8")
def top_terms_ties(spark, sf):
    return _language_terms(spark, sf)


@query("topic_terms", """SELECT lang AS topic, string_agg(term, ' ' ORDER BY n DESC, term) AS terms
    FROM langterms WHERE place <= 8 GROUP BY lang""")
def topic_terms(spark, sf):
    return topics.topic_terms(_language_terms(spark, sf)).select("topic", F.array_join("terms", " ").alias("terms"))


@query("topic_labels", """SELECT lang AS topic, string_agg(concat(upper(term[1]), term[2:]), ', ' ORDER BY n DESC, term) AS label,
    lpad(lang, 2, '0') AS number FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r
    FROM langterms WHERE place <= 8) WHERE r <= 3 GROUP BY lang""")
def topic_labels(spark, sf):
    return topics.topic_labels(topics.topic_terms(_language_terms(spark, sf)))


_PROFILE = " , ".join(
    f"count(*) FILTER ({base.group_sql('polarity')} = '{s}') AS {s}" for s in ("positive", "neutral", "negative")
)


@query("sentiment_profile", f"SELECT {_PROFILE} FROM docentries")
def sentiment_profile(spark, sf):
    return topics.sentiment_profile(base.document_entries(spark, sf))


@query("sentiment_profile_by_group", f"SELECT source, {_PROFILE} FROM docentries GROUP BY source")
def sentiment_profile_by_group(spark, sf):
    return topics.sentiment_profile(base.document_entries(spark, sf), "source")


@query("topic_share", f"""SELECT lang AS topic, {base.percent_sql('positive', '(positive + neutral + negative)')} AS pos_pct,
    {base.percent_sql('negative', '(positive + neutral + negative)')} AS neg_pct FROM (SELECT lang, {_PROFILE} FROM docentries GROUP BY lang)""")
def topic_share(spark, sf):
    by_language = base.document_entries(spark, sf).withColumnRenamed("lang", "topic")
    return topics.topic_share(topics.sentiment_profile(by_language, "topic"))
