"""Text functions on columns.

Unicode normalisation forms have no SQL function, so values pass through an
Arrow-batched UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .bind import let

#: White space as the calendar and contact formats' tools trim it.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Mailbox names that many people share: fixed values.
GENERIC_MAILBOXES = ["admin", "contact", "hello", "help", "info", "office", "sales", "support", "team", "webmaster"]
ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfkd_bare(s: pd.Series) -> pd.Series:
    drop = dict.fromkeys(range(0x300, 0x370))
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x).translate(drop))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None else [unicodedata.normalize("NFKC", x) if x is not None else None for x in v])


def nfkc_each(values: Column) -> Column:
    """NFKC of an array's texts; functions that take `form` may then be used inside lambdas, where UDFs can't be."""
    return F.when(F.forall(values, lambda x: F.coalesce(x, F.lit("")).rlike(ASCII)), values).otherwise(_nfkc_each(values))


def as_is(c: Column) -> Column:
    return c


def nfkc_parts(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """rows and an array column for each of parts, arrays of texts, in NFKC; all of a row go through the UDF as one array."""
    none = F.array().cast("array<string>")
    sized = rows.select("*", *(F.coalesce(p, none).alias(f"{n}_raw") for n, p in parts.items()))
    whole = sized.withColumn("nfkc_whole", nfkc_each(F.concat(*(f"{n}_raw" for n in parts))))
    out, start = [], F.lit(1)
    for n in parts:
        out.append(F.slice("nfkc_whole", start, F.size(f"{n}_raw")).alias(n))
        start = start + F.size(f"{n}_raw")
    return whole.select("*", *out).drop("nfkc_whole", *(f"{n}_raw" for n in parts))


def nfkc(c: Column) -> Column:
    # Spark calls the UDF for every row, whatever the condition, which would work c out again at each mention
    return _nfkc(c)


def without_marks(c: Column) -> Column:
    """NFKD without combining marks U+0300 to U+036F."""
    return F.when(c.rlike(ASCII), c).otherwise(_nfkd_bare(c))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def normalize_event_text(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed; null as empty."""
    return collapse(F.lower(trim(F.coalesce(c, F.lit("")))))


def normalize_text(c: Column, form: Callable[[Column], Column] = nfkc) -> Column:
    """As normalize_event_text, after NFKC."""
    return collapse(trim(F.lower(form(F.coalesce(c, F.lit(""))))))


def normalize_email(c: Column, form: Callable[[Column], Column] = nfkc) -> Column:
    """Trimmed, NFKC, lower case; dots and +tags stay."""
    return F.lower(form(trim(F.coalesce(c, F.lit("")))))


normalize_uid = normalize_email


def normalize_phone(c: Column, form: Callable[[Column], Column] = nfkc) -> Column:
    """Digits with an optional + and an xEXTENSION; empty if it isn't a number of five digits or more. 00 reads as +."""
    text = F.lower(form(trim(F.coalesce(c, F.lit("")))))
    extension = F.regexp_extract(text, r"(?:ext\.?|extension|x)\s*(\d+)$", 1)
    main = F.regexp_replace(text, r"\s*(?:ext\.?|extension|x)\s*\d+$", "")
    main = F.regexp_replace(F.regexp_replace(main, r"[\s().-]+", ""), "^00", "+")
    ok = main.rlike(r"^\+?\d+$") & (F.length(F.regexp_replace(main, r"\D", "")) >= 5)
    return F.when(ok, F.concat(main, F.when(extension != "", F.concat(F.lit("x"), extension)).otherwise(""))).otherwise("")


def normalize_name(c: Column) -> Column:
    """Without accents, lower case, letters, digits, ' and - only, words separated by one blank."""
    bare = F.lower(without_marks(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}'-]+", " "))


def search_key(c: Column) -> Column:
    """Accents and case don't count."""
    return F.lower(without_marks(F.coalesce(c, F.lit(""))))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of normalised names; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def is_generic_mailbox(email: Column) -> Column:
    return F.substring_index(email, "@", 1).isin(GENERIC_MAILBOXES)


def escape_ics(c: Column) -> Column:
    """Backslash, line end, semicolon and comma escaped."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"\r\n|\r|\n", r"\\n")
    return F.when(c.rlike(r"[\\\r\n;,]"), F.regexp_replace(out, r"([;,])", r"\\$1")).otherwise(c)


def unescape_text(c: Column) -> Column:
    """Escaped line ends, commas, semicolons and backslashes read back; other backslashes stay."""

    def part(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"\\[nN]", "\n"), r"\\([,;])", "$1")

    # what is between escaped backslashes has none of them, so its own escapes are plain
    return F.when(c.contains("\\"), F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")).otherwise(c)


def unfold(c: Column) -> Column:
    """Lines that start with a blank or tab join the one before; line ends become \\n."""
    joined = lambda x: F.when(x.contains("\n ") | x.contains("\n\t"), F.regexp_replace(x, r"\n[ \t]", "")).otherwise(x)
    return let(plain_ends(c), joined)


def plain_ends(c: Column) -> Column:
    """CRLF and CR as \\n."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fold(line: Column) -> Column:
    """Parts of 75 bytes at most, those after the first behind a blank that counts; no part ends within a character.

    A line's UTF-8 bytes are taken as characters of one byte each while it is cut.
    """
    raw = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    head = F.regexp_extract(raw, r"(?s)^.{1,75}(?![\x80-\xBF])", 0)
    rest = F.regexp_replace(F.substring(raw, F.length(head) + 1, F.length(raw)), r"(?s)(.{1,74})(?![\x80-\xBF])", "\r\n $1")
    return F.when(F.octet_length(line) <= 75, line).otherwise(F.decode(F.encode(F.concat(head, rest), "ISO-8859-1"), "UTF-8"))


def is_safe_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def protect_formula(c: Column) -> Column:
    """A leading ' for text that a spreadsheet would calculate."""
    return F.when(c.rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def file_stem(c: Column) -> Column:
    """The name without its extension, other than letters, digits, _ and - as -."""
    return F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), r"[^A-Za-z0-9_-]+", "-")


def base64_bytes(c: Column) -> Column:
    """Estimated bytes of base64 text."""
    bare = F.regexp_replace(c, r"\s+", "")
    pad = F.length(F.regexp_extract(bare, r"(={0,2})$", 1))
    return F.greatest(F.lit(0), F.floor(F.length(bare) * 3 / 4) - pad).cast("long")


def readable_size(c: Column) -> Column:
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(F.format_number(c / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(c / (1024 * 1024), 1), F.lit(" MB")))
