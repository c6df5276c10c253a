import pytest

from feedback_spark.llm.frames import importable

TEXTS = [
    None, "", "   ", "one", "The cat sat on the mat.\nThe cat sat on the mat.\n\tIt's 12 o'clock, isn't it?", "é ü ß Ünïcode — “quoted” 漢字 İ Σας",
    "word " * 3000, "x" * 20_000, "<|endoftext|> a <|startoftext|>b", "a  b   c ", "tab\tand\x1cseparator\x85next space", "dup line\ndup line\ndup line",
]


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture
def docs(frame):
    """Awkward texts, with nulls, repeated rows and extra columns that clash with added ones."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None)]
    return frame("doc_id long, text string, lang string, source string, ids long", *rows)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
