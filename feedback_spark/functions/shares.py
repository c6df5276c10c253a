"""Expressions over ``map<string,double>`` columns of shares."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Names people see for the emotions that are kept, in display order.
EMOTION_NAMES = {
    "happiness": "Joy",
    "sadness": "Sadness",
    "anger": "Anger",
    "surprise": "Surprise",
    "fear": "Fear",
    "disgust": "Disgust",
}


def emotion_name(key: Column) -> Column:
    shown = key
    for name, label in EMOTION_NAMES.items():
        shown = F.when(key == name, label).otherwise(shown)
    return shown


def _ranked(shares: Column) -> Column:
    """Entries from the largest share down, equal shares by name."""
    return F.array_sort(
        F.transform(
            F.map_entries(shares),
            lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("key")),
        )
    )


def dominant(shares: Column) -> Column:
    """Name of the largest share, an empty text when there is none."""
    return F.coalesce(F.get(_ranked(shares), F.lit(0))["key"], F.lit(""))


def plain_number(value: Column) -> Column:
    """A double in plain digits, never with an exponent: 0.0005, 0.25, 1.0."""
    digits = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)


def shares_text(shares: Column) -> Column:
    """``name=share; name=share`` from the largest share down."""
    return F.coalesce(
        F.array_join(
            F.transform(
                _ranked(shares),
                lambda e: F.concat(e["key"], F.lit("="), plain_number(-e["rank"])),
            ),
            "; ",
        ),
        F.lit(""),
    )


def total(shares: Column) -> Column:
    return F.aggregate(F.map_values(shares), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


# Fields that tell a bare record from a record of records.
RECORD_FIELDS = ["word", "emotion", "topic", "class", "bigram"]


def records(text: Column, fields: str) -> Column:
    """Records of a JSON text that is a list, one bare record, or a record of records.

    ``fields`` is the record schema, such as ``emotion string, pct double``.
    Elements of a list that are no records are left out, the others stay. A
    record with one of the fields that mark one, or with a value that is no
    record, is a bare record.
    """
    kind = T.StructType.fromDDL(fields)

    def is_record(part: Column) -> Column:
        return F.coalesce(F.startswith(F.ltrim(part), F.lit("{")), F.lit(False))

    def parsed(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.from_json(p, kind))

    listed = F.filter(F.from_json(text, "array<string>"), is_record)
    held = F.from_json(text, "map<string,string>")
    marked = F.exists(F.map_keys(held), lambda k: k.isin(RECORD_FIELDS))
    values = F.map_values(held)
    nested = ~marked & (F.size(values) > 0) & F.forall(values, is_record)
    empty = F.array().cast(T.ArrayType(kind))
    of_record = (
        F.when(F.size(values) == 0, empty).when(nested, parsed(values)).otherwise(F.array(F.from_json(text, kind)))
    )
    return F.coalesce(F.when(is_record(text), of_record).otherwise(parsed(listed)), empty)
