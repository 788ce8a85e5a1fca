"""Searching, filtering, sorting and paging events, occurrences and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import search_key
from ..session import cut


def search_events(events: DataFrame, query: str = "", start: str = "", timezone: str = "", recurring: bool | None = None) -> DataFrame:
    """Events that hold the query in title, location, description, organizer or attendees, from a day on, in a zone, recurring or not."""
    text = F.lower(F.concat_ws(" ", "title", "location", "description", "organizer", F.array_join("attendees", " ")))
    out = events
    if query.strip():
        out = out.where(F.contains(text, F.lower(F.lit(query.strip()))))
    if start:
        out = out.where(F.substring("start_time.value", 1, 10) >= start)
    if timezone:
        out = out.where(F.col("timezone") == timezone)
    if recurring is not None:
        out = out.where((F.coalesce("rrule", F.lit("")) != "") == F.lit(recurring))
    return out


def search_contacts(contacts: DataFrame, query: str = "", presence: str = "", source_file: str = "", version: str = "") -> DataFrame:
    """Contacts that hold the query, accents and case aside; presence: email, phone, organization, address or notes."""
    have = {"email": F.size("emails") > 0, "phone": F.size("phones") > 0, "organization": F.col("organization") != "", "address": F.size("addresses") > 0, "notes": F.size("notes") > 0}
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), " ")
    text = F.concat_ws(" ", "formatted_name", "given_name", "family_name", "organization", "title", joined("emails"), joined("phones"), joined("addresses"), F.array_join("categories", " "), F.array_join("notes", " "))
    out = contacts
    if presence:
        out = out.where(have[presence])
    if source_file:
        out = out.where(F.col("source_file") == source_file)
    if version:
        out = out.where(F.col("version") == version)
    if query.strip():
        out = out.where(F.contains(search_key(text), search_key(F.lit(query.strip()))))
    return out


def filter_occurrences(occurrences: DataFrame, which: str = "all") -> DataFrame:
    rules = {"all": F.lit(True), "modified": F.col("status") == "Modified occurrence", "rdate": F.col("status") == "RDATE", "cancelled": F.col("status") == "Cancelled", "warnings": F.col("mismatch")}
    return occurrences.where(rules[which])


def numeric_key(c: Column) -> Column:
    """Text in which runs of digits sort by value: padded to twelve places."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")


def sort_events(events: DataFrame, by: str = "start") -> DataFrame:
    return events.orderBy(F.collate("title", "UNICODE"), "idx") if by == "title" else events.orderBy("start", "idx")


def sort_contacts(contacts: DataFrame, by: str = "name") -> DataFrame:
    column = {"name": "formatted_name", "organization": "organization", "source": "source_file"}[by]
    return contacts.orderBy(F.collate(numeric_key(F.col(column)), "UNICODE_CI_AI"), "source_index", "original_index")


def domain(df: DataFrame, column: str) -> DataFrame:
    """(value, position) of a column's distinct non-empty values, in order: what a filter offers."""
    # the condition is on an aggregate: one on the column would be worked out below a repartition too, where few tasks read a file
    values = df.groupBy(column).agg(F.min(column).alias("value")).where(F.coalesce("value", F.lit("")) != "").select("value")
    return ranked(values, "value").select("value", (F.col("rank") - 1).alias("position"))


def page(df: DataFrame, order: list[Column | str], number: int, size: int = LIMITS.page) -> DataFrame:
    """The number-th page, from 1, in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def presence_counts(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count("*").alias("contacts"), F.count_if(F.size("emails") > 0).alias("with_email"), F.count_if(F.size("phones") > 0).alias("with_phone"), F.count_if(F.col("organization") != "").alias("with_organization"))


def first_diagnostics(diagnostics: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One diagnostic per key, the first in order."""
    return diagnostics.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def in_ranges(df: DataFrame, by: str) -> DataFrame:
    """df dealt by ranges of `by`, with `_part`, the range's number; kept, so that the numbers stay."""
    return cut(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))


def before_ranges(sizes: DataFrame, value: str) -> DataFrame:
    """(_part, _before): the sum of `value` over the ranges before; sizes has one row per range."""
    before = F.coalesce(F.sum(value).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("_part", before.alias("_before"))


def ranked(df: DataFrame, by: str) -> DataFrame:
    """df with `rank`, as SQL's rank() over all rows: rows are dealt by ranges of `by`, ranked inside, and each range starts after those before."""
    parts = in_ranges(df, by)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    own = F.rank().over(Window.partitionBy("_part").orderBy(by))
    return parts.join(before_ranges(sizes, "_n"), "_part").withColumn("rank", (F.col("_before") + own).cast("long")).drop("_part", "_before")


def running_total(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """df with `name`, the sum of `value` over all rows before in the order of `by`, which is unique."""
    parts = in_ranges(df, by)
    sizes = parts.groupBy("_part").agg(F.sum(value).alias("_n"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(before_ranges(sizes, "_n"), "_part").withColumn(name, (F.col("_before") + own).cast("long")).drop("_part", "_before")


#: Rows of a group that are numbered together.
CHUNK = 10_000


def numbered_within(df: DataFrame, group: str, order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`, each row's place from 0 in its group, by `order`, a unique whole number.

    A group is numbered in chunks of its order, which a window takes one by one,
    so one that holds most rows doesn't fall to a task.
    """
    parts = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sizes = parts.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(order)) - 1
    return parts.withColumn("_own", own).join(sizes.select(group, "_chunk", before.alias("_before")), [group, "_chunk"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_chunk", "_own", "_before")
