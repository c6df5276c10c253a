"""Audit of five document filters in every order, by a recursive common table expression.

1. Each document gets a mask: one bit per filter that it fails. The four filters on its own text are column
   expressions; the fifth, being a copy of a document with a smaller id, needs the least id of each text. Rows are added
   up per (text digest, part, document) and then per (text digest, part), so a text that makes up a third of all rows
   arrives as one row per task.
2. A cell is a part and a mask with its numbers of documents, good and toxic ones: at most 32 cells per part.
3. The recursion starts from each mask that occurs, with no filter applied. Each level extends a prefix by every
   letter not used yet and carries the bits applied so far, which say what the new step does to the mask: keep it, remove
   it, or find it removed already. There are 326 prefixes, so the recursion has at most 32 * 326 rows, however many
   documents and parts there are.
4. Cells join these rows by mask and are added up per part and prefix; every full order reads the five prefixes it starts with.

Failure conditions, over words ``[^\\x20\\x09-\\x0D]+``: A under ``LEAST_WORDS`` words; B fewer than half of the words distinct;
C more than 3% of the code points are ``[A-Z]``; D any of ``#$%&*|``; E same text as a row of smaller id, whether
that row is kept or not.

Defined cases: null text is empty and fails A, but not B to D; empty texts are copies of each other. A null part counts as
the part of the empty string. A null id is no copy and makes none; rows that repeat an id and text are not copies of each other, but
all are copies of a smaller id. Repeated labels of an id: the document is good or toxic if any says so; a null label says nothing. A part
has all 600 rows, zeros included; an empty table gives an empty table. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedback_spark.llm.frames import durable, text_key

LETTERS = "ABCDE"
LEAST_WORDS = 200
SPACES = r"[\x20\x09-\x0D]+"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D for a text that is not null."""
    # Cutting at white space leaves an empty piece before a leading and after a trailing run.
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {1: counted["n"] < LEAST_WORDS, 2: 100 * counted["d"] < 50 * counted["n"],
             4: 100 * capitals > 3 * F.length(text), 8: text.rlike(r"[#$%&*|]")}
    return sum((F.when(failed, bit).otherwise(0) for bit, failed in fails.items()), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of the mask."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        text_key(F.col(text_column)).alias("key"), own_mask(text).alias("own"),
    )
    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    said = said.filter("id IS NOT NULL").groupBy("id").agg(
        *[F.max(F.coalesce(c, F.lit(False)).cast("long")).alias(c) for c in ("g", "t")]
    )
    known = narrow.join(said, "id", "left").select(
        "id", "part", "key", "own", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("t", F.lit(0)).alias("t")
    )
    n, good, toxic = F.count(F.lit(1)).alias("n"), F.sum("g").alias("good"), F.sum("t").alias("toxic")
    # Equal texts fail the same of the first four filters.
    per_id = known.groupBy("key", "part", "id").agg(F.first("own").alias("own"), n, good, toxic)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "good", "toxic")))
    without = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_null") for c in ("n", "good", "toxic")]
    # One row per text and part, used twice.
    groups = durable(per_id.groupBy("key", "part").agg(F.first("own").alias("own"), least.alias("least"), *sums, *without), "text_groups")
    firsts = groups.groupBy("key").agg(F.min("least.id").alias("first_id"))
    marked = groups.join(firsts, "key").withColumn("is_first", F.coalesce(F.col("least.id") == F.col("first_id"), F.lit(False)))
    free = [(F.col(f"{c}_null") + F.when(F.col("is_first"), F.col(f"least.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    kinds = marked.select("part", "own", F.struct(*free).alias("free"), F.struct("n", "good", "toxic").alias("all"))
    split = kinds.select("part", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), *[F.col(f"free.{c}").alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("own") + 16).alias("mask"), *[(F.col(f"all.{c}") - F.col(f"free.{c}")).alias(c) for c in ("n", "good", "toxic")]),
    )).alias("cell")).select("part", "cell.*").filter("n > 0")
    return split.groupBy("part", "mask").agg(*sums)


PREFIXES = """
WITH RECURSIVE walk(mask, prefix, bit, before, applied) AS (
  SELECT mask, '', 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT mask, concat(prefix, letter), new_bit, applied, applied | new_bit
  FROM (SELECT mask, prefix, applied, inline(filter({letters}, l -> (applied & l.new_bit) = 0)) FROM walk)
)
SELECT prefix, bit, mask,
       mask & applied = 0 AS kept, mask & bit != 0 AND mask & before = 0 AS removed,
       mask & bit != 0 AND mask & before != 0 AS redundant, mask = bit AS unique_fails
FROM walk WHERE prefix != ''
"""


def prefix_outcomes(cells: DataFrame) -> DataFrame:
    """(prefix, bit, mask, kept, removed, redundant, unique_fails): what the last filter of a prefix does to a mask."""
    spark = cells.sparkSession
    letters = ", ".join(f"named_struct('letter', '{c}', 'new_bit', {1 << i})" for i, c in enumerate(LETTERS))
    statement = PREFIXES.format(masks="{masks}", letters=f"array({letters})")
    # At most 32 rows of one number, stored so that no level of the recursion repeats their making.
    return spark.sql(statement, masks=durable(cells.select("mask").distinct(), "masks"))


def audit(docs: DataFrame, labels: DataFrame, part_column: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    cells = durable(mask_cells(docs, labels, part_column), "cells")
    steps = durable(prefix_outcomes(cells), "prefixes")

    def of(flag: str, number: str, name: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(number)).otherwise(0)).alias(name)

    per_prefix = cells.join(steps, "mask").groupBy("part", "prefix").agg(
        of("kept", "n", "kept"), of("removed", "n", "removed"), of("redundant", "n", "redundant"),
        of("unique_fails", "n", "unique_fails"), of("removed", "good", "good_lost"), of("removed", "toxic", "toxic_lost"),
    )
    full = steps.filter(F.length("prefix") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")).withColumn(
        "prefix", F.expr("left(filter_order, step)")
    )
    rows = per_prefix.join(orders, "prefix").withColumn("letter", F.expr("right(prefix, 1)"))
    total = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley")
