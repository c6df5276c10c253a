"""Documents that arrive as JSON bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BODY = "documents array<struct<raw_text:string,label:string>>"


def json_documents(bodies: DataFrame, column: str = "body", *keep: str) -> DataFrame:
    """(…, pos, raw_text, label) of all ``documents`` in the JSON texts of ``column``.

    A body without the list is an error, as it is for a caller that sends one.
    """
    listed = F.from_json(column, BODY)["documents"]
    checked = F.when(listed.isNotNull(), listed).otherwise(
        F.raise_error(F.lit("JSON must contain a 'documents' array"))
    )
    return bodies.select(*keep, F.posexplode(checked).alias("pos", "d")).select(*keep, "pos", "d.*")
