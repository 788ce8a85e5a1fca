"""Contacts: vCard files to contacts and diagnostics.

Cards are extracted, their lines parsed and quoted-printable values decoded in
column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS, Limits
from ..functions.bind import let
from ..functions.text import base64_bytes, is_safe_url, unescape_text
from ..operators.search import numbered_within, ranked
from ..session import stored
from .properties import first_value, named, parameter, parse_line

UNNAMED = "(Unnamed contact)"
BEGIN, END = r"(?i)\nBEGIN:VCARD[ \t]*\n", r"(?i)\nEND:VCARD(?=\s|$)"
VERSIONS = ["2.1", "3.0", "4.0"]
LATIN = ["iso-8859-1", "latin1", "windows-1252"]
CHARSETS = ["", "utf-8", "utf8", "us-ascii", *LATIN]
#: Bytes 80 to 9F of Latin text are read as Windows has them, where it has some.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
MARKS = CONTROLS.encode("latin-1").decode("cp1252")
ADDRESS = ["po_box", "extended", "street", "locality", "region", "postal_code", "country"]


@dataclass(frozen=True)
class Contacts:
    contacts: DataFrame
    diagnostics: DataFrame


def decoded(value: Column, charset: Column) -> Column:
    """(text, fine) of a quoted-printable value.

    Escapes become bytes by `unhex`, all else its UTF-8 bytes; the bytes together are then a text of the charset. Bytes
    that aren't UTF-8 are read as Latin text if no charset is named, and leave the value as it is otherwise; both
    aren't fine. A value of an unknown charset stays as it is.
    """
    name = F.replace(F.lower(charset), F.lit("_"), F.lit("-"))
    parts = F.split(value, "=")
    bytes_of = lambda t: F.hex(F.encode(t, "UTF-8"))
    piece = lambda p, i: F.when(i == 0, bytes_of(p)).when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.left(p, F.lit(2)), bytes_of(F.substring(p, 3, 2**31 - 1)))).otherwise(bytes_of(F.concat(F.lit("="), p)))

    def of(raw: Column) -> Column:
        latin = F.translate(F.decode(raw, "ISO-8859-1"), CONTROLS, MARKS)
        fine = F.is_valid_utf8(raw.cast("string")) | name.isin(LATIN)
        text = F.when(name.isin(LATIN) | (~fine & (name == "")), latin).when(fine, F.decode(raw, "UTF-8")).otherwise(value)
        return F.struct(text.alias("text"), fine.alias("fine"))

    read = let(F.unhex(F.array_join(F.transform(parts, piece), "")), of)
    return F.when(name.isin(CHARSETS), read).otherwise(F.struct(value.alias("text"), F.lit(True).alias("fine")))


def unfold_vcf(c: Column) -> Column:
    """Folded lines join the one before, and so do lines after a quoted-printable soft break. The result starts with a line end."""
    lines = F.concat(F.lit("\n"), F.regexp_replace(c, r"\r\n?", "\n"))
    # \G goes on where the last soft break of the same value ended
    soft = F.regexp_replace(lines, r"(?i)(\n[^\n:]*QUOTED-PRINTABLE[^\n:]*:|\G(?!^))([^\n]*?)=\n", "$1$2")
    return F.regexp_replace(F.when(lines.rlike("(?i)QUOTED-PRINTABLE"), soft).otherwise(lines), r"\n[ \t]", "")


def card_blocks(body: Column) -> Column:
    """The lines of each card of an unfolded text that starts with a line end. A card that doesn't end before the next begins has none."""
    ended = F.filter(F.transform(let(F.split(body, BEGIN), lambda x: F.slice(x, 2, F.size(x))), lambda b: F.split(F.concat(F.lit("\n"), b), END, 2)), lambda b: F.size(b) > 1)
    return F.transform(ended, lambda b: F.concat(F.substring(F.get(b, F.lit(0)), 2, 2**31 - 1), F.lit("\n")))


def cards(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """A row per card with its parsed properties, quoted-printable values decoded, and `told`."""
    body = files.select("source_index", "source_file", unfold_vcf(F.coalesce("text", F.lit(""))).alias("body"))
    return parsed_cards(body.select("source_index", "source_file", F.posexplode(F.slice(card_blocks(F.col("body")), 1, limits.contacts)).alias("original_index", "block")), limits)


def parsed_cards(each: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The same of blocks (source_index, source_file, original_index, block), with `told`, what was wrong with lines: oversized, invalid, encoding.

    Lines over the limit, and lines that are no properties, don't count. A value whose encoding can't be read stays as it is.
    """
    lines = F.split("block", "\n")
    fits = F.filter(lines, lambda x: F.length(x) <= limits.property_chars)
    kept = each.select("source_index", "source_file", "original_index", F.concat(F.lit("BEGIN:VCARD\r\n"), F.replace("block", F.lit("\n"), F.lit("\r\n")), F.lit("END:VCARD")).alias("raw"), (F.size(lines) - F.size(fits)).alias("oversized"), F.explode(F.array(F.transform(F.filter(fits, lambda x: F.trim(x) != ""), parse_line))).alias("lines"))
    types = lambda x, name: F.coalesce(x["parameters"][name], F.array().cast("array<string>"))
    quoted = lambda x: F.exists(types(x, "ENCODING"), lambda e: F.upper(e).isin("QUOTED-PRINTABLE", "QP", "Q")) | F.exists(types(x, "TYPE"), lambda e: F.upper(e) == "QUOTED-PRINTABLE")
    valued = lambda x: F.struct(x.alias("p"), F.when(quoted(x), decoded(x["value"], parameter(x, "CHARSET"))).alias("v"))
    read = kept.select("*", F.explode(F.array(F.transform(F.filter("lines", lambda x: x["name"] != ""), valued))).alias("read"))
    p = F.transform("read", lambda r: r["p"].withField("value", F.coalesce(r["v"]["text"], r["p"]["value"])))
    told = F.struct(F.col("oversized"), F.exists("lines", lambda x: x["name"] == "").alias("invalid"), F.exists("read", lambda r: F.coalesce(~r["v"]["fine"], F.lit(False))).alias("encoding"))
    return read.select("source_index", "source_file", "original_index", "raw", told.alias("told"), F.explode(F.array(p)).alias("p"))


def types_of(p: Column) -> Column:
    """Lower-case TYPE values, PREF and encodings not counted."""
    empty = F.array().cast("array<string>")
    each = F.flatten(F.transform(F.coalesce(p["parameters"]["TYPE"], empty), lambda t: F.split(F.lower(t), ",")))
    return F.filter(each, lambda t: ~t.isin("pref", "quoted-printable", "base64", "8bit", "7bit"))


def preference_of(p: Column) -> Column:
    """PREF if it is a positive integer, 1 if a TYPE says so, else null."""
    pref = F.expr("cast(null as int)")
    number = F.try_to_number(parameter(p, "PREF"), F.lit("999999999")).cast("int")
    typed = F.exists(F.coalesce(p["parameters"]["TYPE"], F.array().cast("array<string>")), lambda t: F.lower(t) == "pref")
    return F.when(number > 0, number).when(typed, 1).otherwise(pref)


def typed_struct(p: Column, value: Column) -> list[Column]:
    return [value.alias("value"), types_of(p).alias("types"), preference_of(p).alias("preference"), p["parameters"].alias("parameters")]


def components(value: Column, n: int) -> list[Column]:
    parts = F.split(value, r"(?<!\\);")
    return [unescape_text(F.coalesce(F.get(parts, F.lit(k)), F.lit(""))) for k in range(n)]


def address(p: Column) -> Column:
    parts = components(p["value"], 7)
    formatted = F.array_join(F.filter(F.array(*parts), lambda x: F.trim(x) != ""), ", ")
    return F.struct(*typed_struct(p, formatted), *(x.alias(c) for x, c in zip(parts, ADDRESS, strict=True)), formatted.alias("formatted"))


def url(p: Column) -> Column:
    return F.struct(*typed_struct(p, F.trim(p["value"])), is_safe_url(F.trim(p["value"])).alias("safe_protocol"))


def media(properties: Column, name: str) -> Column:
    """embedded (with a size estimate), remote (with the reference), or unsupported."""
    p = F.get(named(properties, name), F.lit(0))
    value = p["value"]
    data = F.regexp_extract(value, r"^data:([^;,]*)[^,]*,(.*)$", 2)
    embedded = F.upper(parameter(p, "ENCODING")).isin("B", "BASE64") | value.startswith("data:")
    kind = F.when(embedded, "embedded").when(is_safe_url(value), "remote").otherwise("unsupported")
    size = F.when(embedded, base64_bytes(F.when(value.startswith("data:"), data).otherwise(value)))
    return F.when(p.isNotNull(), F.struct(kind.alias("kind"), F.lower(F.coalesce(F.nullif(F.regexp_extract(value, r"^data:([^;,]*)", 1), F.lit("")), F.nullif(parameter(p, "MEDIATYPE"), F.lit("")), parameter(p, "TYPE"))).alias("media_type"), F.lower(parameter(p, "ENCODING")).alias("encoding"), size.alias("estimated_bytes"), F.when(~embedded, value).alias("reference"), is_safe_url(value).alias("safe_protocol")))


def parse_vcf(files: DataFrame, limits: Limits = LIMITS) -> Contacts:
    """Contacts of FILES rows; ids are source_index:original_index:(uid, name or `unnamed`). Texts without a card give an error row."""
    contacts, per_card = contacts_of(cards(files, limits), limits)
    one = finding
    body = files.select("source_index", "source_file", F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")).alias("body"))
    begins, ends = F.regexp_count("body", F.lit(r"(?i)\nBEGIN:VCARD")), F.regexp_count("body", F.lit(r"(?i)\nEND:VCARD"))
    whole = F.array_compact(F.array(
        F.when(begins == 0, one("error", "MALFORMED_VCARD", "The file has no card.")),
        F.when(begins > ends, one("error", "TRUNCATED_VCARD", "A card doesn't end.")),
        F.when(ends > begins, one("warning", "MALFORMED_VCARD", "A card's end has no beginning.")),
        F.when(begins > limits.contacts, one("warning", "CONTACT_LIMIT_REACHED", "The file has too many cards.")),
    ))
    per_file = body.select("source_index", "source_file", F.lit(None).cast("int").alias("original_index"), F.explode(whole).alias("i"))
    return Contacts(contacts, per_card.unionByName(per_file).select("source_index", "source_file", "original_index", "i.severity", "i.code", "i.message"))


def parse_components(rows: DataFrame, limits: Limits = LIMITS) -> Contacts:
    """Contacts of COMPONENTS rows (see `splits`) of VCARD; files and cards are numbered by name and place."""
    rows = stored(rows)
    names = ranked(rows.select("source_file").distinct(), "source_file").select("source_file", (F.col("rank") - 1).cast("int").alias("source_index"))
    placed = rows.join(names, "source_file")
    found = numbered_within(placed.where("kind = 'VCARD'"), "source_index", "offset", "original_index")
    block = F.get(card_blocks(unfold_vcf(F.col("text"))), F.lit(0))
    contacts, per_card = contacts_of(parsed_cards(found.select("source_index", "source_file", F.col("original_index").cast("int").alias("original_index"), block.alias("block")), limits), limits)
    torn = placed.where("kind in ('UNENDED', 'UNBEGUN')").select("source_index", "source_file", F.lit(None).cast("int").alias("original_index"), F.when(F.col("kind") == "UNENDED", finding("error", "TRUNCATED_VCARD", "A card doesn't end.")).otherwise(finding("warning", "MALFORMED_VCARD", "A card's end has no beginning.")).alias("i"))
    empty = names.join(placed.where("kind = 'VCARD'").select("source_index").distinct(), "source_index", "left_anti").select("source_index", "source_file", F.lit(None).cast("int").alias("original_index"), finding("error", "MALFORMED_VCARD", "The file has no card.").alias("i"))
    return Contacts(contacts, per_card.unionByName(torn).unionByName(empty).select("source_index", "source_file", "original_index", "i.severity", "i.code", "i.message"))


def finding(severity: str, code: str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def contacts_of(rows: DataFrame, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """Contacts, and diagnostics as structs `i`, of cards."""
    p = F.col("p")
    text = lambda *names: unescape_text(first_value(p, *names))
    many = lambda name, f: F.slice(F.transform(named(p, name), f), 1, limits.repeated_values)
    names, org = components(first_value(p, "N"), 5), F.split(first_value(p, "ORG"), r"(?<!\\);")
    words = lambda c: F.filter(F.transform(F.split(c, r"(?<!\\),"), unescape_text), lambda x: F.trim(x) != "")
    raw_names = [F.coalesce(F.get(F.split(first_value(p, "N"), r"(?<!\\);"), F.lit(k)), F.lit("")) for k in range(5)]
    joined = F.trim(F.regexp_replace(F.concat_ws(" ", names[3], names[1], names[2], names[0], names[4]), r"\s+", " "))
    formatted = F.coalesce(F.nullif(F.trim(text("FN")), F.lit("")), F.nullif(joined, F.lit("")), F.lit(UNNAMED))
    uid = F.trim(first_value(p, "UID"))
    contacts = rows.where(F.size(p) > 0).select(
        F.concat_ws(":", "source_index", "original_index", F.coalesce(F.nullif(uid, F.lit("")), F.when(formatted != UNNAMED, formatted), F.lit("unnamed"))).alias("id"),
        "source_index", "original_index", F.trim(first_value(p, "VERSION")).alias("version"), formatted.alias("formatted_name"), names[1].alias("given_name"), words(raw_names[2]).alias("additional_names"),
        names[0].alias("family_name"), words(raw_names[3]).alias("honorific_prefixes"), words(raw_names[4]).alias("honorific_suffixes"), unescape_text(F.get(org, F.lit(0))).alias("organization"),
        F.transform(F.slice(org, 2, F.greatest(F.size(org) - 1, F.lit(0))), unescape_text).alias("organization_units"), text("TITLE").alias("title"), text("ROLE").alias("role"),
        many("EMAIL", lambda x: F.struct(*typed_struct(x, F.trim(unescape_text(x["value"]))))).alias("emails"), many("TEL", lambda x: F.struct(*typed_struct(x, F.trim(F.regexp_replace(x["value"], "(?i)^tel:", ""))))).alias("phones"),
        many("ADR", address).alias("addresses"), many("URL", url).alias("urls"), first_value(p, "BDAY").alias("birthday"), first_value(p, "ANNIVERSARY").alias("anniversary"),
        F.flatten(F.transform(named(p, "CATEGORIES"), lambda x: words(x["value"]))).alias("categories"), F.transform(named(p, "NOTE"), lambda x: unescape_text(x["value"])).alias("notes"), text("NICKNAME").alias("nickname"),
        first_value(p, "GENDER").alias("gender"), uid.alias("uid"), first_value(p, "KIND").alias("kind"), media(p, "PHOTO").alias("photo"), media(p, "LOGO").alias("logo"), first_value(p, "GEO").alias("geo"), first_value(p, "TZ").alias("timezone"),
        "source_file", p.alias("raw_properties"), "raw",
    )
    version = F.trim(first_value(p, "VERSION"))
    one = finding
    found = F.array_compact(F.array(
        F.when(F.col("told.oversized") > 0, one("warning", "OVERSIZED_PROPERTY", "A line is too long and was left out.")),
        F.when(F.col("told.invalid"), one("warning", "INVALID_PROPERTY", "A line is no property.")),
        F.when(F.col("told.encoding"), one("warning", "INVALID_ENCODING", "A quoted-printable value can't be read.")),
        F.when(F.size(p) == 0, one("error", "MALFORMED_VCARD", "The card is empty.")),
        F.when((F.size(p) > 0) & (version == ""), one("warning", "MISSING_VERSION", "The card has no version.")),
        F.when((version != "") & ~version.isin(VERSIONS), one("warning", "UNSUPPORTED_VERSION", "The card's version isn't supported.")),
        F.when((F.size(p) > 0) & (F.trim(text("FN")) == ""), one("warning", "MISSING_FN", "The card has no formatted name.")),
        F.when(F.exists(named(p, "URL"), lambda x: ~is_safe_url(F.trim(x["value"]))), one("warning", "UNSAFE_URI", "An address isn't http or https.")),
        F.when(F.size(named(p, "PHOTO", "LOGO")) > 0, one("warning", "UNSUPPORTED_BINARY_FIELD", "Media are kept as metadata only.")),
        F.when(F.exists(p, lambda x: ~F.replace(F.lower(parameter(x, "CHARSET")), F.lit("_"), F.lit("-")).isin(CHARSETS)), one("warning", "UNSUPPORTED_CHARSET", "A value's charset isn't supported.")),
        F.when(F.greatest(*(F.size(named(p, n)) for n in ("EMAIL", "TEL", "ADR", "URL"))) > limits.repeated_values, one("warning", "REPEATED_VALUE_LIMIT_REACHED", "A field has too many values.")),
    ))
    return contacts, rows.select("source_index", "source_file", "original_index", F.explode(found).alias("i"))
