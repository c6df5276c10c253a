"""From raw rows to cleaned documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedback_spark.functions import labels, text


def require_columns(df: DataFrame, *names: str | None) -> None:
    """Fail before planning when a chosen column is missing."""
    missing = [n for n in names if n and n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found; available: {df.columns}")


def build_documents(
    rows: DataFrame,
    text_column: str,
    *,
    key: str = "row_index",
    labelled: bool = False,
    label_column: str | None = None,
) -> DataFrame:
    """(key, raw_text, label): trimmed text, no blank rows, normalised label."""
    require_columns(rows, key, text_column, label_column)
    label = F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")
    return rows.select(
        key,
        text.strip(F.col(text_column)).alias("raw_text"),
        labels.normalise_label(label, F.lit(labelled)).alias("label"),
    ).filter(~text.is_blank(F.col("raw_text")))


def drop_empty_text(df: DataFrame, text_column: str = "raw_text") -> DataFrame:
    return df.filter(F.col(text_column).isNotNull() & (F.length(text_column) > 0))


def clean_documents(documents: DataFrame, *, ascii_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(…, doc_category, cleaned_text, word_count) for texts with a word left.

    The key travels with the row from here on; no later step counts positions
    again, so a dropped row cannot shift the scores of others.
    """
    rest = [c for c in documents.columns if c not in ("raw_text", "label") or c in keep]
    cleaned = text.clean_text(F.col("raw_text"), ascii_only)
    return (
        drop_empty_text(documents)
        .select(
            *rest,
            labels.label_category(F.col("label")).alias("doc_category"),
            F.explode(text.if_kept(cleaned, lambda c: c != "")).alias("cleaned_text"),
        )
        .withColumn("word_count", text.cleaned_word_count(F.col("cleaned_text")))
    )
