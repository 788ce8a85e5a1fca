"""Content lines of calendars and contacts as structs, in column expressions.

A line is [group.]NAME;PARAM=value,"quoted value";BARE:value.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let

PROPERTY = "struct<group:string,name:string,value:string,parameters:map<string,array<string>>,raw:string>"
#: Contact properties that contacts have fields for; others are vendor properties. Fixed values.
STANDARD = ["VERSION", "FN", "N", "ORG", "TITLE", "ROLE", "EMAIL", "TEL", "ADR", "URL", "BDAY", "ANNIVERSARY", "CATEGORIES", "NOTE", "NICKNAME", "GENDER", "UID", "KIND", "PHOTO", "LOGO", "GEO", "TZ", "PRODID", "REV"]
#: What is before a line's first colon outside quotes; possessive, so that the matcher doesn't recurse.
HEAD = r'^((?:"[^"]*+"|[^":]++)*+):'
#: A comma or semicolon outside quotes.
OUTSIDE = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r'^"(.*)"$', "$1")


def parameters_of(c: Column) -> Column:
    """;A=x,"y";B as a map of lists; a bare parameter is a TYPE; repeated names join."""
    parts = F.filter(F.split(c, ";" + OUTSIDE), lambda p: p != "")
    named = F.transform(parts, lambda p: F.struct(F.when(p.contains("="), F.upper(F.substring_index(p, "=", 1))).otherwise("TYPE").alias("name"), F.transform(F.split(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(p), "," + OUTSIDE), unquote).alias("values")))
    return let(named, by_name)


def by_name(named: Column) -> Column:
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.flatten(F.transform(F.filter(named, lambda p: p["name"] == n), lambda p: p["values"]))))


def parse_line(line: Column) -> Column:
    """A PROPERTY; its name is empty if the line isn't one."""
    start = F.substring_index(line, ":", 1)
    head = F.when(start.contains('"'), F.regexp_extract(line, HEAD, 1)).when(line.contains(":"), start).otherwise("")

    def of(x: Column) -> Column:
        head, full = x["head"], x["full"]
        name = F.when(full.rlike(r"^(?:[A-Za-z0-9-]+\.)?[A-Za-z0-9-]+$"), F.upper(F.substring_index(full, ".", -1))).otherwise("")
        none = F.expr("cast(map() as map<string,array<string>>)")
        parameters = F.when(head.contains(";"), parameters_of(F.substring(head, F.length(full) + 1, F.length(head)))).otherwise(none)
        return F.struct(F.when(full.contains("."), F.substring_index(full, ".", 1)).otherwise("").alias("group"), name.alias("name"), F.substring(line, F.length(head) + 2, F.length(line)).alias("value"), parameters.alias("parameters"), line.alias("raw"))

    return let(head, lambda h: let(F.struct(h.alias("head"), F.substring_index(h, ";", 1).alias("full")), of))


def parse_lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), parse_line), lambda p: p["name"] != "")


def named(properties: Column, *names: str) -> Column:
    """The properties of these names, in order. Names are looked up natively before each property is asked."""
    there = functools.reduce(Column.__or__, (F.array_contains(properties["name"], n) for n in names))
    return F.when(there, F.filter(properties, lambda p: p["name"].isin(*names))).otherwise(F.slice(properties, 1, 0))


def first(properties: Column, *names: str) -> Column:
    """The first such property, or null."""
    if len(names) == 1:
        return F.get(properties, (F.array_position(properties["name"], names[0]) - 1).cast("int"))
    return F.get(named(properties, *names), F.lit(0))


def first_value(properties: Column, *names: str) -> Column:
    """The first such property's value, or empty."""
    return F.coalesce(first(properties, *names)["value"], F.lit(""))


def parameter(p: Column, name: str) -> Column:
    """A parameter's first value, or empty."""
    return F.coalesce(F.get(p["parameters"][name], F.lit(0)), F.lit(""))


def sorted_parameters(p: Column) -> Column:
    """Parameters as name=values texts by name; transport parameters don't count."""
    named = F.filter(F.map_entries(F.coalesce(p, F.expr("cast(map() as map<string,array<string>>)"))), lambda e: ~e["key"].isin("CHARSET", "ENCODING"))
    return F.array_sort(F.transform(named, lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.array_sort(F.transform(e["value"], lambda v: F.lower(F.trim(v))))))))


def vendor_properties(properties: Column) -> Column:
    """The contact properties that no field stands for, each once."""
    other = F.filter(F.coalesce(properties, F.array().cast(f"array<{PROPERTY}>")), lambda p: ~p["name"].isin(STANDARD))
    same = lambda p: F.to_json(F.struct(F.coalesce(p["group"], F.lit("")).alias("g"), p["name"].alias("n"), p["value"].alias("v"), sorted_parameters(p["parameters"]).alias("o")))
    first = lambda found: F.filter(found, lambda p, k: F.array_position(F.transform(found, same), same(p)) == k + 1)
    return F.when(F.size(other) > 0, let(other, first)).otherwise(other)
