"""Contact output: vCard 4.0, or the cards as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_ics, fold
from ..sources.properties import vendor_properties
from ..sources.vcf import ADDRESS

#: Parameters that are written, by name: fixed values.
ALLOWED = ["ALTID", "LANGUAGE", "MEDIATYPE", "PID", "VALUE"]


def parameter_value(v: Column) -> Column:
    """Without line ends and quotes, within quotes if it holds a separator."""
    clean = F.regexp_replace(v, r'[\r\n"]', "")
    return F.when(clean.rlike("[:,;]"), F.concat(F.lit('"'), clean, F.lit('"'))).otherwise(clean)


def joined(named: Column) -> Column:
    """;NAME=value,value of entries (key, value) that have values, sorted by name."""
    kept = F.array_sort(F.filter(named, lambda e: F.size(e["value"]) > 0))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.lit(";"), e["key"], F.lit("="), F.array_join(F.transform(e["value"], parameter_value), ","))), "")


def parameters(x: Column, text: Column | None = None) -> Column:
    """;PREF, ;TYPE and allowed others, sorted by name; VALUE=text where `text` says so."""
    own = ["TYPE", "PREF"] if text is None else ["TYPE", "PREF", "VALUE"]
    entry = lambda name, values: F.struct(F.lit(name).alias("key"), values.alias("value"))
    none = F.array().cast("array<string>")
    value = F.coalesce(x["parameters"]["VALUE"], none)
    more = [entry("TYPE", x["types"]), entry("PREF", F.when(x["preference"].isNotNull(), F.array(x["preference"].cast("string"))).otherwise(none))]
    more += [] if text is None else [entry("VALUE", F.when(text, F.array(F.lit("text"))).otherwise(value))]
    return joined(F.concat(F.filter(F.map_entries(x["parameters"]), lambda e: e["key"].isin(ALLOWED) & ~e["key"].isin(own)), F.array(*more)))


def vendor_line(p: Column) -> Column:
    """A vendor property as it is written: its group and name, allowed parameters, the escaped value."""
    token = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9-]", "-")
    group = F.when(F.coalesce(p["group"], F.lit("")) != "", F.concat(token(p["group"]), F.lit("."))).otherwise("")
    kept = F.filter(F.map_entries(p["parameters"]), lambda e: e["key"].isin(*ALLOWED, "TYPE", "PREF"))
    return F.concat(group, token(p["name"]), joined(kept), F.lit(":"), escape_ics(p["value"]))


def contact_lines(contacts: DataFrame) -> DataFrame:
    text = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}:"), escape_ics(F.col(c))))
    part = lambda c: escape_ics(F.coalesce(F.col(c), F.lit("")))
    listed = lambda c: F.array_join(F.transform(c, escape_ics), ",")
    name = F.concat(F.lit("N:"), F.concat_ws(";", part("family_name"), part("given_name"), listed("additional_names"), listed("honorific_prefixes"), listed("honorific_suffixes")))
    org = F.when(F.coalesce("organization", F.lit("")) != "", F.concat(F.lit("ORG:"), F.array_join(F.concat(F.array(part("organization")), F.transform("organization_units", escape_ics)), ";")))
    many = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name), parameters(x), F.lit(":"), escape_ics(x["value"])))
    phones = F.transform("phones", lambda x: F.concat(F.lit("TEL"), parameters(x, ~x["value"].contains(":")), F.lit(":"), escape_ics(x["value"])))
    vendor = F.transform(vendor_properties(F.col("raw_properties")), vendor_line)
    addresses = F.transform("addresses", lambda x: F.concat(F.lit("ADR"), parameters(x), F.lit(":"), F.concat_ws(";", *(escape_ics(x[c]) for c in ADDRESS))))
    urls = F.transform("urls", lambda x: F.concat(F.lit("URL"), parameters(x), F.lit(":"), x["value"]))
    head = F.array(F.lit("BEGIN:VCARD"), F.lit("VERSION:4.0"), F.concat(F.lit("FN:"), part("formatted_name")), name, org, text("TITLE", "title"), text("ROLE", "role"))
    notes = F.transform("notes", lambda n: F.concat(F.lit("NOTE:"), escape_ics(n)))
    categories = F.when(F.size("categories") > 0, F.concat(F.lit("CATEGORIES:"), listed("categories")))
    tail = F.array(text("BDAY", "birthday"), text("ANNIVERSARY", "anniversary"), categories, text("NICKNAME", "nickname"), text("GENDER", "gender"), text("UID", "uid"), text("KIND", "kind"), text("GEO", "geo"), text("TZ", "timezone"))
    return contacts.withColumn("lines", F.array_compact(F.concat(head, many("EMAIL", "emails"), phones, addresses, urls, tail, notes, vendor, F.array(F.lit("END:VCARD")))))


def contact_text(contacts: DataFrame, key: list[str]) -> DataFrame:
    return contact_lines(contacts).select(*key, F.array_join(F.transform("lines", fold), "\r\n").alias("text"))


def write_contacts(contacts: DataFrame, path: str, original: bool = False) -> None:
    """Cards in source order: serialised anew, or as they were read."""
    key = ["source_index", "original_index"]
    texts = contacts.select(*key, F.col("raw").alias("text")) if original else contact_text(contacts, key)
    texts.repartitionByRange(*key).sortWithinPartitions(*key).select("text").write.option("lineSep", "\r\n").text(path)
