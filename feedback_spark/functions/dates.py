"""Month of a date written as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedback_spark.functions.text import strip

# The accepted layouts and the shape each one has.
LAYOUTS = {
    r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$": "yyyy-M-d'T'H:m:s",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$": "yyyy-M-d H:m:s",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
}


def parse_period(raw: Column) -> Column:
    """``yyyy-MM`` of a date text, its first seven characters as a last resort, else null.

    The shape decides which layout is parsed, as a failing parse is dear.
    """
    text = strip(raw)
    head = F.substring(text, 1, 19)
    moment = F.lit(None).cast("timestamp")
    for shape, layout in LAYOUTS.items():
        moment = F.when(head.rlike(shape), F.try_to_timestamp(head, F.lit(layout))).otherwise(moment)
    loose = F.when(
        (F.length(text) >= 7) & (F.substring(text, 5, 1) == "-"), F.substring(text, 1, 7)
    )
    return F.coalesce(F.date_format(moment, "yyyy-MM"), loose)
