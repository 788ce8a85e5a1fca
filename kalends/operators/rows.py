"""CSV and list rows of events, occurrences and contacts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import protect_formula
from ..functions.time import shown

#: Column orders are fixed by the tools' files.
EVENT_COLUMNS = ["title", "start", "end", "timezone", "time_kind", "all_day", "location", "description", "organizer", "attendees", "categories", "recurrence_rule", "status", "uid", "source_file"]
CONTACT_COLUMNS = ["full_name", "given_name", "family_name", "organization", "job_title", "emails", "phones", "addresses", "websites", "birthday", "categories", "notes", "vcard_version", "uid", "source_file"]
LONG_COLUMNS = ["repeated_field", "repeated_value", "repeated_types", "repeated_preference"]
KINDS = {"utc": "UTC", "zoned": "Time zone", "floating": "Floating", "date": "All-day"}


def chosen(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """df with the chosen columns, one at least."""
    if columns is None:
        return df
    if not columns:
        raise ValueError("choose one column at least")
    return df.select(*columns)


def event_rows(events: DataFrame, columns: list[str] | None = None, time_mode: str = "original", zone: str = "UTC", protect: bool = False) -> DataFrame:
    """EVENT_COLUMNS; lists joined by '; '. protect makes formulas inert, which this tool doesn't do by itself."""
    rows = events.select(
        "title", shown(F.col("start_time"), time_mode, zone).alias("start"), F.coalesce(shown(F.col("end_time"), time_mode, zone), F.lit("")).alias("end"), "timezone", "time_kind", "all_day", "location", "description",
        "organizer", F.array_join("attendees", "; ").alias("attendees"), F.array_join("categories", "; ").alias("categories"), F.col("rrule").alias("recurrence_rule"), "status", "uid", "source_file",
    )
    if protect:
        rows = rows.select(*(protect_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    return chosen(rows, columns)


def values(c: str) -> Column:
    return F.transform(c, lambda x: x["value"])


def contact_rows(contacts: DataFrame, columns: list[str] | None = None, protect: bool = True) -> DataFrame:
    """CONTACT_COLUMNS; lists joined by ' | '; formulas made inert but in phones."""
    joined = lambda c: F.array_join(c, " | ")
    rows = contacts.select(
        F.col("formatted_name").alias("full_name"), "given_name", "family_name", F.concat_ws(" | ", F.nullif(F.col("organization"), F.lit("")), F.nullif(joined(F.col("organization_units")), F.lit(""))).alias("organization"),
        F.col("title").alias("job_title"), joined(values("emails")).alias("emails"), joined(values("phones")).alias("phones"), joined(values("addresses")).alias("addresses"), joined(values("urls")).alias("websites"), "birthday",
        joined(F.col("categories")).alias("categories"), joined(F.col("notes")).alias("notes"), F.col("version").alias("vcard_version"), "uid", "source_file",
    )
    if protect:
        rows = rows.select(*(F.col(c) if c == "phones" else protect_formula(F.col(c)).alias(c) for c in rows.columns))
    return chosen(rows, columns)


def long_rows(contacts: DataFrame) -> DataFrame:
    """A row per email, phone, address and website, one empty row for a contact without any: id, position, LONG_COLUMNS."""

    def of(field: str, c: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(field).alias("field"), x["value"].alias("value"), F.array_join(x["types"], ", ").alias("types"), F.coalesce(x["preference"].cast("string"), F.lit("")).alias("preference")))

    every = F.concat(of("email", "emails"), of("phone", "phones"), of("address", "addresses"), of("website", "urls"))
    rows = contacts.select("id", F.posexplode_outer(every).alias("position", "x"))
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    return rows.select("id", F.coalesce("position", F.lit(0)).alias("position"), text("field").alias("repeated_field"), F.when(text("field") == "phone", text("value")).otherwise(protect_formula(text("value"))).alias("repeated_value"), text("types").alias("repeated_types"), text("preference").alias("repeated_preference"))


def viewer_rows(events: DataFrame) -> DataFrame:
    kind = F.lit("Unknown")
    for k, label in KINDS.items():
        kind = F.when(F.col("time_kind") == k, label).otherwise(kind)
    return events.select("title", "start", "end", "timezone", kind.alias("time_kind"), "location", F.when(F.col("rrule") != "", "Yes").otherwise("No").alias("recurring"), "source_file")


def detail_rows(contacts: DataFrame) -> DataFrame:
    """(id, field, value) of a contact's non-empty single fields."""
    fields = ["formatted_name", "given_name", "family_name", "nickname", "organization", "title", "role", "birthday", "anniversary", "gender", "kind", "geo", "timezone", "uid"]
    stack = ", ".join(f"'{f}', {f}" for f in fields)
    return contacts.select("id", F.expr(f"stack({len(fields)}, {stack}) as (field, value)")).where(F.trim(F.coalesce("value", F.lit(""))) != "")


def comparison(contacts: DataFrame, groups: DataFrame, fields: list[str]) -> DataFrame:
    """(group, field, values): each field of a group's members side by side, by idx."""
    stack = ", ".join(f"'{f}', coalesce(cast({f} as string), '')" for f in fields)
    long = groups.join(contacts, "idx").select("group", "idx", F.expr(f"stack({len(fields)}, {stack}) as (field, value)"))
    return long.groupBy("group", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("values"))


def messages(diagnostics: DataFrame) -> DataFrame:
    """Distinct diagnostic lines."""
    return diagnostics.select(F.concat_ws(": ", F.nullif(F.col("source_file"), F.lit("")), F.concat(F.upper("severity"), F.lit(" "), F.col("code")), "message").alias("message")).dropDuplicates()


def displayed(df: DataFrame, name: str) -> Column:
    """A column as a list shows it: arrays joined by commas, Yes or No, empty for null."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        return F.array_join(F.transform(name, lambda x: x.cast("string")), ", ")
    if kind == "boolean":
        return F.when(F.col(name), "Yes").when(~F.col(name), "No").otherwise("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def label(name: str) -> str:
    """A column's heading: words apart, the first letter capital."""
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", name.replace("_", " "))
    return words[:1].upper() + words[1:]
