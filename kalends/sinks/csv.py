"""CSV output: quotes where needed, CRLF, empty for null, a byte-order mark if wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(columns: list[str]) -> Column:
    """A row's CSV line."""
    return F.concat_ws(",", *(cell(F.col(c)) for c in columns))


#: What spreadsheets take UTF-8 by.
BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Part files of lines, each with a header, and with a byte-order mark if wanted; all quoting is done in the JVM."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])  # the header is a file's first line
    df.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\r\n").csv(path)
