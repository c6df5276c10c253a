"""Registry, word lists and shared frames of the catalogue of queries.

Every query reads whole tables. ``CTES`` holds the same frames for the SQL
side; ``sql`` puts those a statement names in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedback_spark.functions.text import WHITE_SPACE
from feedback_spark.operators import cleaning
from feedback_spark.session import spread
from feedback_spark.sources.lexicons import Lexicons, Shifters, inline_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = sql(statement)
        return fn

    return add


# Word lists made of words that occur in the test tables.
POSITIVE = "thor inti ble best erst than elle ment los heit the".split()
NEGATIVE = "ntble ththti ing license er ver des que ung the".split()
WEIGHTS = {
    "thor": 0.75, "inti": 0.5, "ble": 0.4, "best": 1.0, "erst": 0.25, "than": 0.6, "elle": 0.8,
    "ment": 0.3, "los": 0.5, "heit": 0.7, "ntble": -0.5, "ththti": -1.0, "ing": -0.4,
    "license": -0.25, "er": -0.3, "ver": -0.8, "des": -0.2, "que": -0.6, "ung": -0.75,
}
EMOTIONS = {
    "joy": "thor best elle los erst", "sadness": "ntble er ing", "anger": "ver ththti que",
    "fear": "ung des que", "surprise": "erst inti heit", "disgust": "license er",
    "trust": "than ment", "anticipation": "ble thor", "positive": "best thor", "negative": "ver er",
}
STOPS = "the and that for was with this are from les des der die und que".split()
SHIFTERS = Shifters(negators=("on", "un", "nd"), amplifiers=("of", "de"), softeners=("is", "et"))


def lexicons(spark: SparkSession) -> Lexicons:
    polarity = [(w, "positive") for w in POSITIVE] + [(w, "negative") for w in NEGATIVE]
    emotion = [(w, e) for e, listed in EMOTIONS.items() for w in listed.split()]
    return Lexicons(
        polarity=inline_table(spark, "word, sentiment", polarity),
        weights=inline_table(spark, "word, weight", list(WEIGHTS.items())),
        emotions=inline_table(spark, "word, sentiment", emotion),
        stops=inline_table(spark, "word", [(w,) for w in STOPS]),
        shifters=SHIFTERS,
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else f"{c}::DOUBLE" for c in r) + ")" for r in rows)


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- documents as feedback -------------------------------------------------

LABEL = """CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'neg' ELSE ' Negative' END
    WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'POSITIVE' ELSE 'pos' END
    WHEN quality = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'mixed' ELSE 'neutral' END END"""


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", *(columns or ("text",))))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label) with the label as people typed it."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return documents(spark, sf).join(labels, "doc_id", "left").selectExpr("doc_id", "text", f"{LABEL} AS label")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.col("text").alias("raw_text"), F.lit("neutral").alias("label"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_documents(raw_documents(spark, sf)).select("doc_id", "cleaned_text", "word_count")


# ---- events as entries -----------------------------------------------------

CENTS = {"spark": "CAST(rint(value * 100) AS BIGINT)", "duckdb": "CAST(round_even(value * 100, 0) AS BIGINT)"}

ENTRY_COLUMNS = [
    "event_id AS row_index",
    """concat(event_type, ' by user ', CAST(user_id AS STRING), ' worth ', CAST(cents AS STRING), ' ', props)
        AS original_text""",
    """CASE WHEN cents % 100 < 15 THEN 'Very Positive' WHEN cents % 100 < 45 THEN 'Positive'
        WHEN cents % 100 < 65 THEN 'Neutral' WHEN cents % 100 < 90 THEN 'Negative'
        ELSE 'Very Negative' END AS polarity""",
    "CAST(50 + cents % 50 AS DOUBLE) / 100 AS polarity_confidence",
    """CASE event_type WHEN 'error' THEN 'complaint' WHEN 'click' THEN 'suggestion' WHEN 'view' THEN 'inquiry'
        WHEN 'purchase' THEN 'compliment' WHEN 'signup' THEN 'statement' END AS intent""",
    "event_id % 7 = 0 AS sarcasm_flag",
    """CAST(CASE WHEN event_id % 7 = 0 THEN 70 + cents % 20 ELSE cents % 25 END AS DOUBLE) / 100
        AS sarcasm_confidence""",
]

SHARES = {
    "happiness": "CAST(cents % 11 AS DOUBLE) / 20",
    "sadness": "CAST(cents % 7 AS DOUBLE) / 20",
    "anger": "CAST(cents % 5 AS DOUBLE) / 10",
    "fear": "CAST(user_id % 4 AS DOUBLE) / 10",
}

ASPECT_1 = ("event_type", "polarity", "CAST(cents % 21 - 10 AS DOUBLE) / 10")
ASPECT_2 = (
    "concat('part ', CAST(user_id % 12 AS STRING))",
    "CASE cents % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'mildly NEGATIVE' ELSE 'mixed' END",
    "CAST(cents % 9 - 4 AS DOUBLE) / 4",
)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "events")).selectExpr("*", f"{CENTS['spark']} AS cents")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated rows with emotions and aspects, made of events."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in SHARES.items())
    none = "CAST(map() AS MAP<STRING,DOUBLE>)"
    first, second = (
        f"array(named_struct('term', {t}, 'sentiment', {s}, 'score', {x}))" for t, s, x in (ASPECT_1, ASPECT_2)
    )
    no_aspects = "CAST(array() AS ARRAY<STRUCT<term:STRING,sentiment:STRING,score:DOUBLE>>)"
    return (
        events(spark, sf)
        .selectExpr("*", *ENTRY_COLUMNS)
        .selectExpr(
            "row_index", "original_text", "polarity", "polarity_confidence", "intent", "sarcasm_flag",
            "sarcasm_confidence",
            f"CASE WHEN event_id % 13 = 0 THEN {none} ELSE map({pairs}) END AS emotions",
            f"""concat(CASE WHEN event_id % 4 <> 0 THEN {first} ELSE {no_aspects} END,
                       CASE WHEN event_id % 3 = 0 THEN {second} ELSE {no_aspects} END) AS aspects""",
        )
    )


DAY = {
    "spark": "date_add(DATE '2024-01-01', CAST(event_id % 700 AS INT))",
    "duckdb": "(DATE '2024-01-01' + CAST(event_id % 700 AS INT))",
}


def _when(engine: str) -> str:
    """A date text in one of the accepted layouts, or a bad one."""

    def show(java: str, c: str) -> str:
        if engine == "spark":
            return f"date_format({DAY['spark']}, {java})"
        return f"strftime({DAY['duckdb']}, '{c}')"

    return f"""CASE event_id % 6
        WHEN 0 THEN {show("'yyyy-MM-dd'", "%Y-%m-%d")}
        WHEN 1 THEN concat({show("'yyyy-MM-dd'", "%Y-%m-%d")}, 'T08:15:30.250')
        WHEN 2 THEN concat(' ', {show("'yyyy-MM-dd'", "%Y-%m-%d")}, ' 23:59:59 ')
        WHEN 3 THEN {show("'MM/dd/yyyy'", "%m/%d/%Y")}
        WHEN 4 THEN concat({show("'yyyy'", "%Y")}, '-13-99')
        ELSE {show("'MMM yyyy'", "%b %Y")} END"""


def dated_entries(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(*ENTRY_COLUMNS, f"{_when('spark')} AS happened")


# Raw class and probabilities as a model might send them, bad values included.
RAW = [
    "event_id AS row_index",
    """CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'neutral'
        WHEN 3 THEN 'unknown' ELSE ' positive' END AS sentiment""",
]
P_POSITIVE = "CASE WHEN event_id % 11 = 0 THEN 'high' ELSE CAST(CAST(cents % 101 AS DOUBLE) / 100 AS STRING) END"
P_NEGATIVE = "CAST(CAST(cents % 1001 AS DOUBLE) / 1000 AS STRING)"
P_NEUTRAL = "CAST(CAST(cents % 31 AS DOUBLE) / 31 AS STRING)"


def raw_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(
        *RAW,
        f"""CASE WHEN event_id % 7 = 0 THEN map('negative', {P_NEGATIVE})
            ELSE map('positive', {P_POSITIVE}, 'negative', {P_NEGATIVE}, 'neutral', {P_NEUTRAL}) END AS probabilities""",
    )


# Level and confidence of a document, by a fixed rule on its key and length.
DOC_ENTRY = [
    """CASE (doc_id + n_chars) % 5 WHEN 0 THEN 'Very Positive' WHEN 1 THEN 'Positive' WHEN 2 THEN 'Neutral'
        WHEN 3 THEN 'Negative' ELSE 'Very Negative' END AS polarity""",
    "CAST(n_chars % 101 AS DOUBLE) / 100 AS polarity_confidence",
]


def document_entries(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "text", "n_chars", "lang", "source").selectExpr(
        "doc_id", "text", "lang", "source", *DOC_ENTRY
    )


# ---- the SQL side ----------------------------------------------------------

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def strip_sql(value: str) -> str:
    return f"trim({value}, {_BLANKS})"


def clean_sql(value: str) -> str:
    text = f"regexp_replace(lower({value}), 'https?://[^\\s\\p{{Z}}]+|www\\.[^\\s\\p{{Z}}]+', ' ', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    text = f"regexp_replace({text}, '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"


def half_up(value: str, digits: int) -> str:
    return f"floor({value} * {10.0**digits} + 0.5) / {10.0**digits}"


def half_even(value: str, digits: int) -> str:
    return f"round_even({value} * {10.0**digits}, 0) / {10.0**digits}"


def percent_sql(part: str, total: str) -> str:
    return (
        f"CASE WHEN {total} = 0 THEN 0::BIGINT ELSE "
        f"CAST(floor({part}::DOUBLE / {total} * 100.0 + 0.5) AS BIGINT) END"
    )


def level_sql(score: str) -> str:
    return f"""CASE WHEN {score} > 0.15 THEN 'Very Positive' WHEN {score} > 0.02 THEN 'Positive'
        WHEN {score} < -0.15 THEN 'Very Negative' WHEN {score} < -0.02 THEN 'Negative' ELSE 'Neutral' END"""


def group_sql(polarity: str) -> str:
    return f"""CASE WHEN {polarity} IN ('Very Positive', 'Positive') THEN 'positive'
        WHEN {polarity} IN ('Negative', 'Very Negative') THEN 'negative' ELSE 'neutral' END"""


def order_sql(polarity: str) -> str:
    return f"""CASE {polarity} WHEN 'Very Positive' THEN 1 WHEN 'Positive' THEN 2 WHEN 'Neutral' THEN 3
        WHEN 'Negative' THEN 4 WHEN 'Very Negative' THEN 5 ELSE 6 END"""


def score_sql(polarity: str) -> str:
    return f"""CASE {polarity} WHEN 'Very Positive' THEN 1.0 WHEN 'Positive' THEN 0.5 WHEN 'Negative' THEN -0.5
        WHEN 'Very Negative' THEN -1.0 ELSE 0.0 END"""


LEVELS_SQL = "(VALUES ('Very Positive'), ('Positive'), ('Neutral'), ('Negative'), ('Very Negative')) l(polarity)"

_PERIOD_FORMATS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y"]


def period_sql(value: str) -> str:
    text = f"trim({value})"
    tries = ", ".join(f"try_strptime(left({text}, 19), '{f}')" for f in _PERIOD_FORMATS)
    return f"""coalesce(strftime(coalesce({tries}), '%Y-%m'),
        CASE WHEN length({text}) >= 7 AND substr({text}, 5, 1) = '-' THEN substr({text}, 1, 7) END)"""


def _entry_select() -> str:
    return ", ".join(ENTRY_COLUMNS).replace("AS STRING", "AS VARCHAR")


CTES = {
    "feedback": f"SELECT d.doc_id, text, {LABEL.replace('doc_id', 'd.doc_id')} AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "built": f"""SELECT doc_id, {strip_sql('text')} AS raw_text,
        CASE WHEN label IS NULL OR label = '' THEN 'neutral'
             WHEN lower({strip_sql('label')}) IN ('pos', 'positive') THEN 'pos'
             WHEN lower({strip_sql('label')}) IN ('neg', 'negative') THEN 'neg'
             ELSE lower({strip_sql('label')}) END AS label
        FROM feedback WHERE length({strip_sql('text')}) > 0""",
    "clean": f"""SELECT * FROM (SELECT doc_id, {clean_sql('text')} AS cleaned_text FROM documents
        WHERE text IS NOT NULL AND length(text) > 0) WHERE cleaned_text <> ''""",
    "tok": """SELECT doc_id, generate_subscripts(string_split(cleaned_text, ' '), 1) - 1 AS pos,
        unnest(string_split(cleaned_text, ' ')) AS word FROM clean""",
    "bing": f"SELECT * FROM (VALUES {_values([(w, 'positive') for w in POSITIVE] + [(w, 'negative') for w in NEGATIVE])}) v(word, sentiment)",
    "weights": f"SELECT * FROM (VALUES {_values(list(WEIGHTS.items()))}) v(word, weight)",
    "emolex": f"SELECT * FROM (VALUES {_values([(w, e) for e, ws in EMOTIONS.items() for w in ws.split()])}) v(word, sentiment)",
    "stops": f"SELECT * FROM (VALUES {_values([(w,) for w in STOPS])}) v(word)",
    "hits": "SELECT t.doc_id, t.pos, t.word, b.sentiment FROM tok t JOIN bing b ON t.word = b.word",
    "pn": """SELECT doc_id, count(*) FILTER (sentiment = 'positive') AS positive,
        count(*) FILTER (sentiment = 'negative') AS negative FROM hits GROUP BY doc_id""",
    "marked": f"""SELECT doc_id, pos, word,
        coalesce(sum(CASE WHEN word IN ({_words(SHIFTERS.negators)}) THEN 1 ELSE 0 END) OVER before, 0)
        + coalesce(sum(CASE WHEN word IN ({_words(SHIFTERS.negators)}) THEN 1 ELSE 0 END) OVER later, 0) AS flips,
        coalesce(sum(CASE WHEN word IN ({_words(SHIFTERS.amplifiers)}) THEN 1 WHEN word IN ({_words(SHIFTERS.softeners)}) THEN -1 ELSE 0 END) OVER before, 0)
        + coalesce(sum(CASE WHEN word IN ({_words(SHIFTERS.amplifiers)}) THEN 1 WHEN word IN ({_words(SHIFTERS.softeners)}) THEN -1 ELSE 0 END) OVER later, 0) AS scale
        FROM tok WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        later AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""",
    "valence": """SELECT m.doc_id, count(*) AS word_count,
        CAST(coalesce(sum(CAST(round_even(weight * 1000000000, 0) AS BIGINT) * CASE WHEN flips % 2 = 1 THEN -1 ELSE 1 END
            * greatest(0, 10 + 8 * scale)), 0) AS DOUBLE) / 10000000000.0 / sqrt(count(*)) AS valence_score
        FROM marked m LEFT JOIN weights w ON m.word = w.word GROUP BY m.doc_id""",
    "scored": f"""SELECT *, {level_sql('polarity_score')} AS polarity_class FROM (
        SELECT *, 0.65::DOUBLE * valence_score + 0.35::DOUBLE * bing_score AS polarity_score FROM (
        SELECT v.doc_id, v.word_count, v.valence_score, coalesce(p.positive, 0) AS positive, coalesce(p.negative, 0) AS negative,
            coalesce((p.positive - p.negative)::DOUBLE / (p.positive + p.negative + 1), 0) AS bing_score
        FROM valence v LEFT JOIN pn p ON v.doc_id = p.doc_id))""",
    "wc": "SELECT word, count(*) AS n FROM tok GROUP BY word",
    "topw": """SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM wc
        WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stops) ORDER BY n DESC, word LIMIT 30""",
    "emo": f"""SELECT emotion, n, {half_even('(100.0::DOUBLE * n / sum(n) OVER ())', 1)} AS pct FROM (
        SELECT e.sentiment AS emotion, count(*) AS n FROM tok t JOIN emolex e ON t.word = e.word
        WHERE e.sentiment NOT IN ('positive', 'negative') GROUP BY e.sentiment)""",
    "emodist": f"""SELECT CASE emotion WHEN 'joy' THEN 'happiness' ELSE emotion END AS emotion,
        {half_even('(pct / 100.0)', 4)} AS share FROM emo WHERE emotion NOT IN ('trust', 'anticipation')""",
    "ev": f"SELECT *, {CENTS['duckdb']} AS cents FROM events",
    "entries": f"SELECT *, {_entry_select()}, {_when('duckdb')} AS happened FROM ev",
    "shares": " UNION ALL ".join(
        f"SELECT row_index, '{k}' AS emotion, {v} AS share FROM entries WHERE row_index % 13 <> 0" for k, v in SHARES.items()
    ),
    "dominant": """SELECT row_index, emotion FROM (SELECT row_index, emotion,
        row_number() OVER (PARTITION BY row_index ORDER BY share DESC, emotion) AS r FROM shares) WHERE r = 1""",
    "aspects": " UNION ALL ".join(
        f"SELECT row_index, {t.replace('STRING', 'VARCHAR')} AS term, {s} AS sentiment, {x} AS score FROM entries WHERE {c}"
        for (t, s, x), c in ((ASPECT_1, "event_id % 4 <> 0"), (ASPECT_2, "event_id % 3 = 0"))
    ),
    "docentries": f"SELECT doc_id, text, lang, source, {", ".join(DOC_ENTRY)} FROM documents",
    "trend": f"""SELECT period, {half_even(f"(sum(CAST({score_sql('polarity')} * 2 AS BIGINT))::DOUBLE / 2 / count(*))", 3)} AS avg_polarity
        FROM (SELECT polarity, {period_sql('happened')} AS period FROM entries) WHERE period IS NOT NULL GROUP BY period""",
    "kw20": "SELECT word, n, rank FROM topw WHERE rank <= 20",
    "kwhits": f"""SELECT k.rank, k.word, k.n,
        count(*) FILTER ({group_sql('d.polarity')} = 'positive' AND contains(lower(d.text), k.word)) AS pos_hits,
        count(*) FILTER ({group_sql('d.polarity')} = 'negative' AND contains(lower(d.text), k.word)) AS neg_hits,
        arg_min(d.polarity, d.doc_id) AS first_polarity FROM kw20 k CROSS JOIN docentries d GROUP BY k.rank, k.word, k.n""",
    "kwscores": f"""SELECT side, place, word,
        {half_even("(CASE WHEN side = 'positive' THEN 1 ELSE -1 END * least(0.95::DOUBLE, n::DOUBLE / 50.0))", 2)} AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY rank) AS place FROM (SELECT *,
            CASE WHEN pos_hits > neg_hits THEN 'positive' WHEN neg_hits > pos_hits THEN 'negative'
                 WHEN {group_sql('first_polarity')} = 'positive' THEN 'positive' ELSE 'negative' END AS side FROM kwhits))
        WHERE place <= 10""",
    "langterms": """SELECT lang, word AS term, n, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS place FROM (
        SELECT d.lang, t.word, count(*) AS n FROM tok t JOIN documents d ON t.doc_id = d.doc_id GROUP BY d.lang, t.word)""",
}


def sql(statement: str) -> str:
    """``statement`` behind the CTEs it uses, in the order they build on each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(statement)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {head}\n{statement}" if needed else statement
