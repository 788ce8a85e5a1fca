from dataclasses import replace

import pytest

from kalends.config import LIMITS
from kalends.sources.files import FILES
from kalends.sources.vcf import parse_vcf

CARDS = {
    "plain": ("NOTE;ENCODING=QUOTED-PRINTABLE:caf=C3=A9 =3D ok", "café = ok", set()),
    "latin": ("NOTE;CHARSET=ISO_8859-1;ENCODING=QP:caf=e9 =80", "café €", set()),
    "fallback": ("NOTE;ENCODING=QUOTED-PRINTABLE:caf=E9", "café", {"INVALID_ENCODING"}),
    "named": ("NOTE;CHARSET=UTF-8;ENCODING=QUOTED-PRINTABLE:caf=E9", "caf=E9", {"INVALID_ENCODING"}),
    "unknown": ("NOTE;CHARSET=KOI8;ENCODING=QUOTED-PRINTABLE:caf=E9", "caf=E9", {"UNSUPPORTED_CHARSET"}),
    "no escape": ("NOTE;ENCODING=QUOTED-PRINTABLE:a=XYb é", "a=XYb é", set()),
    "long": ("NOTE:" + "x" * 300, None, {"OVERSIZED_PROPERTY"}),
    "no colon": ("NOTE:fine\nJUST TEXT", "fine", {"INVALID_PROPERTY"}),
    "bad name": ("NOTE:fine\nBÄD;X=1:value", "fine", {"INVALID_PROPERTY"}),
    "blank": ("NOTE:fine\n\n", "fine", set()),
}


@pytest.fixture(scope="module")
def read(spark):
    texts = [f"BEGIN:VCARD\nVERSION:4.0\nFN:{name}\n{lines}\nEND:VCARD\n" for name, (lines, _, _) in CARDS.items()]
    return parse_vcf(spark.createDataFrame([(0, "a.vcf", "".join(texts))], FILES), replace(LIMITS, property_chars=200))


def test_values_and_what_was_wrong_with_lines(read):
    notes = {r.formatted_name: r.notes for r in read.contacts.select("formatted_name", "notes").collect()}
    codes = {name: set() for name in CARDS}
    names = list(CARDS)
    for r in read.diagnostics.collect():
        codes[names[r.original_index]].add(r.code)
    for name, (_, note, told) in CARDS.items():
        assert notes[name] == ([note] if note is not None else []), name
        assert codes[name] == told, name
