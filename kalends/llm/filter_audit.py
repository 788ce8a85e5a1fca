r"""How filters interact: what each removes in every order of them.

A document's failures are bits of a mask. Documents are counted in mask cells,
(part, mask), whose number is bounded by the parts and not by the documents.
Each cell is unpivoted against the steps of all orders; a running bit-or over
the steps before tells which failures came earlier, and sums on conditions give
a step's counts. A filter's total over all orders is a window over its steps.

Identity of texts is that of their SHA-256 and length. A digest's documents
are counted with the least id and how often that occurs, by an aggregate that
combines before its shuffle, so copies of one text are no task's.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from .quality import words_of

#: The filters in the order of their bits, which are letters of `filter_order`.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_failures(text: Column) -> Column:
    """The bits of the filters that need the text alone: few words (1), repeated words (2), capitals (4), symbols (8)."""

    def bits(w: Column) -> Column:
        few = F.size(w) < MIN_WORDS
        repeated = 100 * F.size(F.array_distinct(w)) < DISTINCT_SHARE * F.size(w)
        capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > UPPER_SHARE * F.length(text)
        bit = lambda fails, k: F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
        return bit(few, 0) + bit(repeated, 1) + bit(capitals, 2) + bit(text.rlike(SYMBOLS), 3)

    return let(words_of(text), bits)


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by their failures; E, bit 16, is a copy of a smaller id's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).alias("size"), own_failures(text).alias("mask"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows of one id are one before they are joined; rows without an id have no label
    same = ["part", "digest", "size", "mask"]
    counted = rows.where("id is not null").groupBy("id", *same).agg(F.count("*").alias("n"))
    marked = counted.join(marks, "id", "left").select("id", *same, "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    cell = [*same, "good", "toxic"]
    named = marked.groupBy(*cell).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    unnamed = rows.where("id is null").groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n", F.lit(None).cast("long").alias("least"), F.col("n").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest", "size"))
    # of the cell that holds the text's least id, that id's rows pass; of rows without an id, all do
    pass_ = F.when(F.col("least").isNull() | (F.col("least") == first), F.col("n_least")).otherwise(0)
    split = named.unionByName(unnamed).select("part", "mask", "good", "toxic", "n", pass_.alias("first"))
    each = split.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step from 1, METRICS): one row per part, order of the filters and step.

    A null text is empty, a null part an empty string. An id's labels are those
    of any of its rows; ids without one, and rows without an id, have none.
    Rows that repeat an id count each; they aren't copies of one another, but
    of a smaller id's text. Rows without an id are no copies, nor is any text
    one of theirs. Long texts are read whole. No rows give none; other columns
    of the tables don't matter, whatever their names.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    orders = F.array(*(F.lit("".join(o)) for o in permutations(FILTERS)))
    bit = F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)))[F.col("letter")]
    steps = cells.withColumn("filter_order", F.explode(orders))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    of = lambda rows, n="n": F.sum(F.when(rows, F.col(n)).otherwise(0))
    told = steps.groupBy("part", "filter_order", "at", "letter").agg(
        of(~fails & ~gone).alias("kept"), of(fails & ~gone).alias("removed"), of(fails & gone).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(fails & ~gone, "n_good").alias("good_lost"), of(fails & ~gone, "n_toxic").alias("toxic_lost"),
    )
    told = told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return told.select("part", "filter_order", (F.col("at") + 1).alias("step"), *METRICS)
