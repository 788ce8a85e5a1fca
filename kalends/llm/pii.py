r"""Personal data by candidate gradient boosting, in DataFrame functions alone.

The base rules find email, ip, card and phone spans: a pattern's leftmost
non-overlapping matches, those failing a check being dropped. High-recall
generators propose further spans, which may overlap each other and base spans:
mail addresses in other spellings, national and bare phone numbers, card
numbers in other groups, IPv6 of any form, and account numbers (iban), national
identity numbers (national) and credentials (secret). Boosted trees score each
by its format and context; those that reach their kind's threshold, and that no
better one overlaps, are added. The trees are fitted on `SAMPLE` labelled
candidates made from templates, and each kind's threshold is calibrated on as
many held-out ones; the score is an expression, so nothing leaves the JVM.

The patterns are written so that Java's matcher is linear: runs are possessive
or bounded, and a match may start only at the start of its run, or where the
last one ended.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import private
from .quality import let

#: Kinds of the base rules, and those that only the method finds.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "iban", "national", "secret"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Generators: kind, pattern, and what a text must hold for it to be tried.
WIDE = [
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[({] ?at ?[\])}] ?[a-z0-9-]{1,63}+(?: ?(?:[\[({] ?dot ?[\])}]|\.| dot ) ?[a-z0-9-]{2,63}+){1,5}+", r"(?i)[\[({] ?at ?[\])}]"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ at [a-z0-9-]{1,63}+(?:(?: dot |\.)[a-z]{2,24}+){1,3}+", r"(?i) at \S{1,63}(?: dot |\.)"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9.-])", r"@"),
    ("phone", r"(?<![0-9A-Za-z.,-])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9A-Za-z+.])(?:00|\+)[1-9][0-9]{0,2}(?:[ ./()-]{0,2}[0-9]){6,13}+(?![0-9A-Za-z])", r"(?:00|\+)[1-9]"),
    ("phone", r"(?<![0-9A-Za-z+./-])\(?0[1-9][0-9]{0,4}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}+(?![0-9A-Za-z])", r"0[1-9][0-9]{0,4}\)?[ ./-]"),
    ("phone", r"(?<![0-9A-Za-z+.,/-])[0-9]{7,11}(?![0-9A-Za-z])(?![.,/-][0-9])", r"[0-9]{7}"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[^0-9A-Za-z\n]{1,3}[0-9]{4}){2}[^0-9A-Za-z\n]{1,3}[0-9]{1,7}(?![0-9A-Za-z])", r"[0-9]{4}[^0-9A-Za-z\n]{1,3}[0-9]{4}"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}[^0-9A-Za-z\n]{1,3}[0-9]{6}[^0-9A-Za-z\n]{1,3}[0-9]{4,5}(?![0-9A-Za-z])", r"[0-9]{4}[^0-9A-Za-z\n]{1,3}[0-9]{6}"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", r"[0-9]{13}"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?(?![0-9A-Za-z:])", r"::"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9A-Za-z])", r"[\[(](?:\.|dot)[\])]"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    ("national", r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[ -][0-9]{2}[ -]"),
    ("secret", r"(?i)(?<=\b(?:token|secret|password|passwd|pwd|api.?key|access.?key|private.?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[a-z0-9_+/=!#$%-]{6,128}+", r"(?i)(?:token|secret|pass|pwd|key)[a-z]{0,4}[\"']?\s{0,2}[:=]"),
    ("secret", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}+)(?![A-Za-z0-9])", r"AKIA|gh[pousr]_|sk-"),
]
CONTEXT, SAMPLE, PRECISION = 32, 6000, 0.98
#: Words near a candidate that speak for its kind, and those that speak for none.
CUES = {
    "email": r"(?:e-?mail|mailto|contact|write|reach|inbox|address|correo|courriel|kontakt)", "ip": r"(?:ip|ipv6|ipv4|host|addr|address|from|login|server|client|gateway|dns|ping)",
    "card": r"(?:card|visa|mastercard|amex|credit|debit|paid|payment|cc|karte|carte|tarjeta)", "phone": r"(?:tel|telephone|phone|call|calls|fax|mobile|cell|dial|ring|whatsapp|sms|telefon|t[ée]l|tel[ée]fono|handy|anruf)",
    "iban": r"(?:iban|account|bank|transfer|konto|cuenta|compte|bic)", "national": r"(?:ssn|social security|social|taxpayer|tin|identity|id)", "secret": r"(?:token|secret|password|passwd|pwd|key|auth|bearer)",
}
ANTI = r"(?:isbn|issn|order|invoice|version|ver|part|serial|build|sku|model|ref|reference|article|section|page|doi|patent|population|total|sum|id|lot|item|case|no|nr|std)"
SPAN = "struct<start:int,stop:int,kind:string,value:string,before:string,after:string>"
UNPLACED = "struct<p:int,kind:string,gap:int,value:string,before:string,after:string>"
RATED = "struct<score:double,first:int,stop:int,start:int,kind:string,beaten:boolean>"
#: Distances of a running total's steps.
DOUBLES = [1 << k for k in range(31)]


def none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The array's running totals, combine(value, total before) being associative: by distances of 1, 2, 4 and so on, n log n in all."""

    def of(v: Column) -> Column:
        far = lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(x, F.get(acc, i - d))).otherwise(x))
        return F.aggregate(F.filter(F.array(*map(F.lit, DOUBLES)), lambda d: d < F.size(v)), v, far)

    return let(values, of)


def blocks(rows: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold over the array in blocks of as many rows as there are blocks.

    Spark copies a fold's state at each step, so one that gathers results gathers
    a block's first: n rows cost some n ** 1.5 small copies in all.
    """

    def of(b: Column) -> Column:
        count = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / b).cast("int")))
        return F.aggregate(count, zero, lambda acc, k: step(acc, F.slice(rows, k * b + 1, b)))

    return let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(rows).cast("double"))).cast("int")), of)


def unplaced(text: Column, pattern: str, p: int, kind: str, needs: str) -> Column:
    """The matches of a pattern, the p-th, as an array of UNPLACED: gap is the length of what lies between a match and the one before."""

    def of(m: Column) -> Column:
        def each(parts: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                gap = F.get(parts, i)
                return F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), F.length(gap).alias("gap"), v.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"))

            return F.transform(m, one)

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), each)).otherwise(none(UNPLACED))

    return F.when(text.rlike(needs), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none(UNPLACED))


def located(text: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """The matches of (kind, pattern, needs) as an array of SPAN, pattern by pattern; positions are code points."""
    rows = F.concat(*(unplaced(text, pattern, p, kind, needs) for p, (kind, pattern, needs) in enumerate(patterns)))
    # what ends a match: the lengths of all matches and gaps of its pattern up to it
    size = lambda x: F.struct(x["p"].alias("p"), (x["gap"] + F.length(x["value"])).alias("stop"))
    add = lambda x, y: F.struct(x["p"].alias("p"), (x["stop"] + F.when(x["p"] == y["p"], y["stop"]).otherwise(0)).alias("stop"))

    def placed(r: Column) -> Column:
        def spans(stops: Column) -> Column:
            stop = lambda i: F.get(stops, i)["stop"]
            return F.transform(r, lambda x, i: F.struct((stop(i) - F.length(x["value"])).alias("start"), stop(i).alias("stop"), *(x[c].alias(c) for c in ("kind", "value", "before", "after"))))

        return F.when(F.size(r) > 0, let(running(F.transform(r, size), add), spans)).otherwise(none(SPAN))

    return let(rows, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The base kinds' matches that pass their kind's check."""
    n = lambda s: F.length(digits(s["value"]))

    def passes(s: Column) -> Column:
        k = s["kind"]
        return F.when(k == "ip", s["value"].rlike(OCTETS)).when(k == "card", n(s).between(14, 19) & F.call_function("luhn_check", digits(s["value"]))).when(k == "phone", n(s).between(10, 15)).otherwise(True)

    return F.filter(located(text, [(k, PATTERNS[k], NEEDS[k]) for k in KINDS]), passes)


#: Features of a candidate. Each is a pattern whose match (1) or absence (0) counts in the value, or the text before or after it;
#: `cue` and `anti` are words within CONTEXT, the others are numbers.
MATCHES = {
    "joined": ("after", r"^[A-Za-z0-9_/=%$€£-]"), "listed": ("before", r"[0-9][,;|\t] ?$"), "measured": ("after", r"^ ?(?:kg|km|m|cm|mm|usd|eur|people|inhabitants|years|bytes|mb|gb|hz)\b"),
    "opened": ("before", r"(?:[:=#<(\"']|^) ?$"), "sentence": ("after", r"^(?:[.,;)>\"'\s]|$)"), "parens": ("value", r"\("), "plus": ("value", r"^(?:\+|00)"), "trunk": ("value", r"^\(?0[1-9]"),
    "area": ("value", r"^(?:1[ .-])?\(?[2-9][0-9]{2}\)?[ .-]?[2-9]"), "date": ("value", r"(?:19|20)[0-9]{2}|^[0-3]?[0-9][./-][01]?[0-9][./-]"), "issuer": ("value", r"^(?:3[47]|4|5[1-5]|2[2-7]|6)"), "blanks": ("value", r" "), "dots": ("value", r"[.]"),
    "repeat": ("value", r"([0-9])\1{5}"), "mixed": ("value", r"(?=.*[0-9])(?=.*[A-Za-z])"), "words": ("value", r"^[a-z]+$"), "spelt": ("value", r"(?i)[\[({ ]at[\])} ]"),
}
NUMBERS = ["kind", "n_digits", "length", "luhn", "mod97", "cue", "near_cue", "later_cue", "anti"]
FEATURES = [*NUMBERS, *MATCHES]


def word(pattern: str) -> str:
    """The pattern as whole words."""
    return rf"(?i)(?<![\p{{L}}\p{{N}}]){pattern}(?![\p{{L}}\p{{N}}])"


def mod97(value: Column) -> Column:
    """The check of account numbers: their characters, the first four last, letters as 10 to 35, by 97."""
    bare = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(bare, 5, 64), F.left(bare, F.lit(4)))
    step = lambda acc, c: (F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def feature_columns(s: Column) -> list[Column]:
    kind = F.array_position(F.array(*map(F.lit, ALL_KINDS)), s["kind"])
    flag = lambda c: c.cast("double")
    d = digits(s["value"])

    def cued(text: Column) -> Column:
        found = F.lit(False)
        for k, pattern in CUES.items():
            found = F.when(s["kind"] == k, text.rlike(word(pattern))).otherwise(found)
        return flag(found)

    luhn = F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False)
    numbers = [flag(kind), flag(F.length(d)), flag(F.length(s["value"])), flag(luhn), flag(F.when(s["kind"] == "iban", mod97(s["value"])).otherwise(False)), cued(s["before"]), cued(F.right(s["before"], F.lit(12))), cued(s["after"]), flag(s["before"].rlike(word(ANTI)))]
    return numbers + [flag(s[of].rlike(pattern)) for of, pattern in MATCHES.values()]


def feature_row(kind: str, value: str, before: str, after: str) -> list[float]:
    import regex

    d, before, after = re.sub("[^0-9]", "", value), before[-CONTEXT:], after[:CONTEXT]
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
    bare = value.replace(" ", "").upper()
    check = kind == "iban" and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    cued = lambda text: bool(regex.search(word(CUES[kind]), text))
    parts = {"value": value, "before": before, "after": after}
    numbers = [ALL_KINDS.index(kind) + 1.0, len(d), len(value), 12 <= len(d) <= 19 and total % 10 == 0, check, cued(before), cued(before[-12:]), cued(after), bool(regex.search(word(ANTI), before))]
    return numbers + [bool(regex.search(pattern, parts[of])) for of, pattern in MATCHES.values()]


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """n labelled candidates in made-up sentences, half of them personal data.

    What decides the label is what a value stands for: personal values follow
    their format's rules (checks, area codes, issuers) and come with or without
    a cue; others are dates, sums, references, versions, code or random digits.
    """
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    low = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    pick = rng.choice
    says = {
        "email": ["mail me at ", "contact: ", "write to ", "E-mail: ", "you can reach us via "], "phone": ["call ", "Phone: ", "tel. ", "my mobile is ", "fax ", "dial ", "ring me on ", "Tel "], "card": ["card no ", "Visa ", "paid with card ", "credit card: ", "charged to my Mastercard "],
        "ip": ["login from ", "host ", "IP address ", "client ", "connect to server "], "iban": ["IBAN ", "transfer it to account ", "bank account: ", "IBAN: "], "national": ["SSN ", "SSN: ", "social security number ", "her social is "], "secret": ["token = \"", "password: ", "api_key=", "secret = '", "pwd="],
    }
    plain = ["and then ", "we saw ", "about ", "", "values ", "it was ", "near ", "with ", "over "]
    other = ["order ", "ISBN ", "version ", "part ", "serial no ", "invoice ", "section ", "ref. ", "build ", "item ", "patent ", "a total of ", "population ", "page "]
    ends = [" ", ".", ", ", "", ") ", " and more", " today", "; ", "\" ", "' "]
    odd = ["/", "x", "-2", "%", " kg", " km", " people", "_1", " EUR", "=", " bytes"]

    def checked(d: str) -> str:
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        return d + str((-total) % 10)

    def account() -> str:
        country, own = pick(["DE", "GB", "FR", "ES", "NL"]), num(pick([14, 16, 18]))
        rest = own + "".join(str(int(c, 36)) for c in country) + "00"
        return f"{country}{98 - int(rest) % 97:02d}{own}"

    def grouped(x: str, sizes: list[int], by: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(x[at : at + k])
            at += k
        return by.join(out)

    def email(good: bool) -> str:
        name, site = pick([low(4), low(3) + "." + low(5), "user" + num(2)]), low(pick([4, 7]))
        if good:
            return pick([f"{name} (at) {site} (dot) com", f"{name}[at]{site}.org", f"{name} [AT] {site} [DOT] net", f"{name} at {site} dot com", f"{name} at {site} dot co dot uk", f"{name}@{site}", f"{name}{{at}}{site}.de"])
        return pick([f"{low(4)} at {low(6)}.{low(4)}", f"{low(3)} at {low(5)}.{low(2)}", f"{low(2)}@{num(1)}", f"@{low(5)}"[1:] + "@" + low(2), f"{low(5)} at {low(4)}.{low(3)}"])

    def phone(good: bool) -> str:
        a, b, c = pick("23456789") + num(2), pick("23456789") + num(2), num(4)
        if good:
            by = pick([" ", "-", "."])
            return pick([f"({a}) {b}-{c}", f"({num(3)}) {num(3)}-{c}", by.join([a, b, c]), f"1-{a}-{b}-{c}", a + b + c, f"0{pick('123789')}{num(2)} {num(3)} {num(4)}", f"0{pick('123456789')} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{pick(['44', '49', '33', '1'])} {num(3)} {num(6)}", f"+{pick(['44', '49', '33'])} {num(2)}/{num(6)}", f"0{num(3)}/{num(6)}", f"+{num(2)} {num(3)} {num(4)}"])
        return pick([num(7), num(8), num(10), num(11), f"0{pick('123456789')}.{num(2)}.20{num(2)}", f"0{pick('123456789')}/{num(2)}/19{num(2)}", by_ten(), f"{num(3)} {num(3)} {num(4)}", f"0{pick('12')}-{num(2)}-20{num(2)}"])

    def by_ten() -> str:
        return pick(["20", "19"]) + num(2) + pick(["01", "06", "11"]) + num(2)

    def card(good: bool) -> str:
        d = checked(pick(["4", "51", "55", "37", "6011"]).ljust(4, pick("0123456789")) + num(11)) if good else pick(["7", "8", "9", "0", "1", "4"]) + num(15)
        by = pick([".", "_", "/", "  ", " - ", ":"])
        return pick([grouped(d, [4, 4, 4, 4], by), d if not good else grouped(d, [4, 4, 4, 4], by), grouped(checked(d[:14]) if good else d[:15], [4, 6, 5], pick([" ", "-", "."])), (checked("4" + num(11)) if good else num(13))])

    def ip(good: bool) -> str:
        h = lambda: hexed(pick([1, 2, 4, 4])).lstrip("0") or "0"
        if good:
            return pick([":".join(h() for _ in range(8)), "2001:db8::" + h(), "fe80::" + ":".join(h() for _ in range(pick([1, 4]))), "::1", f"{h()}:{h()}::{h()}", f"10[.]{num(1)}[.]{pick('12')}{num(2)}[.]{num(1)}"])
        return pick(["::", f"{low(1)[0].replace(low(1)[0], 'a')}::b", "::", f"{num(2)}::", f"::{num(1)}{num(2)}", "add::bed", f"{num(1)}::{num(1)}"])

    def national(good: bool) -> str:
        by = pick(["-", "-", " "])
        return by.join([pick("12345678") + num(2), pick("123456789") + num(1), num(4)]) if good else by.join([pick(["000", "666", "9" + num(2), num(3)]), num(2), num(4)])

    def secret(good: bool) -> str:
        return pick([hexed(40), hexed(32), low(6) + num(6) + low(5).upper(), "AKIA" + low(16).upper(), low(8) + num(3) + "!", low(12) + num(10)]) if good else pick([low(6), low(9), "required", "optional", num(6), "string", "undefined", "/" + low(8), "none_yet"])

    makers = {"email": email, "phone": phone, "card": card, "ip": ip, "iban": lambda g: account() if g else pick(["DE", "AB", "XK", "ID"]) + num(pick([14, 18, 20])), "national": national, "secret": secret}
    rows, y, kinds = [], [], []
    for i in range(n):
        kind, good = ALL_KINDS[i % len(ALL_KINDS)], rng.random() < 0.5
        value = makers[kind](good)
        if kind == "secret":
            before = pick(says[kind]) if good or rng.random() < 0.8 else pick(plain)
        elif good:
            before = pick(says[kind]) if rng.random() < 0.85 else pick(plain)
        else:
            before = pick(other) if rng.random() < 0.5 else pick(plain) if rng.random() < 0.95 else pick(says[kind])
        after = pick(ends) if good or rng.random() < 0.6 else pick(odd)
        if kind == "iban" and rng.random() < 0.5:
            value = " ".join(value[k : k + 4] for k in range(0, len(value), 4))
        rows.append(feature_row(kind, value, pick(["", "word word ", "Some text here, ", "(see) "]) + before, after))
        y.append(good)
        kinds.append(kind)
    return np.array(rows, float), np.array(y, float), kinds


@functools.cache
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """The fitted trees, and each kind's threshold for PRECISION on held-out candidates."""
    x, y, _ = labelled(SAMPLE, 1)
    trees = BoostedTrees(trees=60).fit(x, y)
    hx, hy, kinds = labelled(SAMPLE, 2)
    own = {k: np.array([v == k for v in kinds]) for k in ALL_KINDS}
    return trees, {k: trees.threshold(hx[m], hy[m], PRECISION) for k, m in own.items()}


def scored(s: Column) -> Column:
    """How far a candidate's score is over its kind's threshold."""
    trees, least = model()

    def of(f: Column) -> Column:
        limit = F.lit(float("inf"))
        for k, t in least.items():
            limit = F.when(s["kind"] == k, F.lit(t)).otherwise(limit)
        return trees.column(lambda j: f[f"f{j}"]) - limit

    return let(F.struct(*(c.alias(f"f{j}") for j, c in enumerate(feature_columns(s)))), of)


def outside(base: Column, wide: Column) -> Column:
    """The spans of wide, an array of SPAN, that don't lie within a span of base: of the base spans up to their start none ends at their end or later."""
    both = F.array_sort(F.concat(F.transform(base, lambda s: tagged(s, 0)), F.transform(wide, lambda s: tagged(s, 1))))

    def of(r: Column) -> Column:
        covers = running(F.transform(r, lambda x: F.when(x["wide"] == 0, x["span"]["stop"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
        return let(covers, lambda c: F.transform(F.filter(r, lambda x, i: (x["wide"] == 1) & (x["span"]["stop"] > F.get(c, i))), lambda x: x["span"]))

    return let(both, of)


def tagged(s: Column, wide: int) -> Column:
    text = lambda c: (s[c] if wide else F.lit("")).alias(c)
    span = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), text("value"), text("before"), text("after"))
    return F.struct(s["start"].alias("start"), F.lit(wide).alias("wide"), span.alias("span"))


def unbeaten(rated: Column) -> Column:
    """Of an array of RATED by start, those that overlap none of a greater (score, first, stop, kind).

    The sweep holds the spans that reach over the next one's start. A pattern's
    matches don't overlap, so these are no more than there are generators.
    """
    rank = lambda s: F.struct(*(s[c].alias(c) for c in ("score", "first", "stop", "kind")))
    marked = lambda s, beaten: F.struct(*(s[c].alias(c) for c in ("score", "first", "stop", "start", "kind")), beaten.alias("beaten"))

    def step(acc: Column, x: Column) -> Column:
        over = F.filter(acc["open"], lambda a: a["stop"] > x["start"])
        now = let(over, lambda o: F.concat(F.transform(o, lambda a: marked(a, a["beaten"] | (rank(x) > rank(a)))), F.array(marked(x, F.exists(o, lambda a: rank(a) > rank(x))))))
        done = F.filter(acc["open"], lambda a: (a["stop"] <= x["start"]) & ~a["beaten"])
        return F.struct(now.alias("open"), F.concat(acc["out"], done).alias("out"))

    def add(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["open"].alias("open"), none(RATED).alias("out")), step)
        return let(own, lambda d: F.struct(d["open"].alias("open"), F.concat(acc["out"], d["out"]).alias("out")))

    swept = lambda r: let(blocks(r, F.struct(none(RATED).alias("open"), none(RATED).alias("out")), add), lambda acc: F.concat(acc["out"], F.filter(acc["open"], lambda a: ~a["beaten"])))
    return let(rated, lambda r: F.when(F.size(r) > 1, swept(r)).otherwise(r))


def find(docs: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """docs with `base` and `spans`: arrays of struct<start, k, stop, kind>, by start and kind; code points, ends exclusive.

    `spans` holds the base spans, and the candidates that reach their threshold
    but for those within a base span and those that overlap one of a better
    score (of equal ones the earlier, then the longer stays). A null or empty
    text has none; long texts are searched whole; n matches
    take n log n steps, and n ** 1.5 small copies to sort out overlaps. Repeated rows are treated alike, no rows give
    none; columns named as the two are replaced, others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = F.array(*map(F.lit, ALL_KINDS))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).cast("int").alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    once = lambda a: let(a, lambda x: F.filter(x, lambda s, i: (i == 0) | (s != F.get(x, i - 1))))

    def whole(b: Column) -> Column:
        def best(w: Column) -> Column:
            rated = F.transform(outside(b, w), lambda s: F.struct(scored(s).alias("score"), (-s["start"]).alias("first"), s["stop"].alias("stop"), s["start"].alias("start"), s["kind"].alias("kind"), F.lit(False).alias("beaten")))
            # by start, as `outside` leaves them
            return once(order(unbeaten(F.filter(rated, lambda s: s["score"] >= 0))))

        more = let(located(text, WIDE), lambda w: F.when(F.size(w) > 0, best(w)).otherwise(order(w)))
        return F.struct(b.alias(base_col), let(more, lambda m: F.when(F.size(m) > 0, F.array_sort(F.concat(b, m))).otherwise(b)).alias(spans_col))

    # the arrays are made once, behind a struct that the two columns are taken from
    (own,) = private(docs, "pii")
    found = docs.withColumn(own, let(order(base_spans(text)), whole))
    return found.withColumn(base_col, F.col(f"{own}.{base_col}")).withColumn(spans_col, F.col(f"{own}.{spans_col}")).drop(own)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of a text replaced by its kind in brackets, [EMAIL] and so on; overlapping spans by the first one's.

    Null texts stay null, long ones are redacted whole, no rows give none; all
    columns keep their names and order.
    """
    text = F.col(text_col)

    def inside(piece: Column, at: Column, part: Column) -> Column:
        """The piece of the text from `at` on with a block's spans replaced."""

        def step(acc: Column, s: Column) -> Column:
            fresh = F.concat(acc["out"], F.array(F.substring(piece, acc["at"] - at + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            return F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), fresh.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(part, F.struct(at.alias("at"), none("string").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    def of(spans: Column) -> Column:
        def add(acc: Column, part: Column) -> Column:
            # a block takes its own piece off the rest, so that a span's substring doesn't search the whole text
            def taken(stop: Column) -> Column:
                piece = F.substring(acc["rest"], F.lit(1), stop - acc["at"])
                return F.struct(stop.alias("at"), F.substring(acc["rest"], stop - acc["at"] + 1, F.lit(2147483647)).alias("rest"), F.concat(acc["out"], F.array(let(piece, lambda p: inside(p, acc["at"], part)))).alias("out"))

            return let(F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["stop"]))), taken)

        zero = F.struct(F.lit(0).alias("at"), text.alias("rest"), none("string").alias("out"))
        done = let(blocks(spans, zero, add), lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))
        return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)

    base, spans = private(docs, "base", "spans")
    found = find(docs, text_col, base, spans)
    return found.withColumn(text_col, let(F.col(spans), of)).select(*docs.columns)
