r"""Quality rules by distribution divergence, in DataFrame functions alone.

Base rules work on words `[^\x20\x09-\x0D]+`. The method's rule compares two
histograms of a text with those of its language, summed over the whole corpus:
character classes, and the language's common words. A text goes if either
Jensen-Shannon distance exceeds its limit. Short texts have noisy histograms,
so texts under `min_words` words aren't judged by distance.

The texts are read once: their counts are a table in the shared folder, from
which both the sums by language and each text's distances come. Every expensive
array is bound to a lambda's variable, `let`, so that it is made once; Spark
would otherwise evaluate it again at each mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from .common import private, stored

SPACE = r"[\x20\x09-\x0D]"
#: Common function words of the languages, by general knowledge; a parameter.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "est", "que", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Patterns of character classes, which have no character in common.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": SPACE, "mark": r"[.,;:!?'\"()-]"}
#: Largest distances of a kept text, of shortest judged texts, and words of a repeat.
CHAR_LIMIT, WORD_LIMIT, MIN_WORDS, WINDOW = 0.25, 0.26, 80, 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeat_words(w: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the array w, the first ones included."""

    def covered(s: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            near = [F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
            return near[0] | near[1]

        at = F.array_sort(F.transform(F.filter(s, again), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(at, start, step)["n"]

    def found(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    return F.when(F.size(w) > WINDOW, let(windows, found)).otherwise(F.lit(0).cast("long"))


def word_counts(w: Column, words: list[str]) -> Column:
    """How often each of words is in the array w, lower-cased, and how many others there are."""

    # each word between blanks of its own, so that neighbours count too
    padded = F.concat(F.lit(" "), F.lower(F.array_join(w, "  ")), F.lit(" "))

    def counts(t: Column) -> Column:
        each = [((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(f" {x} "), F.lit("")))) / F.lit(len(f" {x} ".encode()))).cast("double") for x in words]
        return F.array(*each)

    return let(let(padded, counts), lambda c: F.concat(c, F.array(F.size(w).cast("double") - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))


def measures(text: Column, lang: Column) -> Column:
    """A struct for a text that isn't null: BASE, `classes` (code points by character class, the rest last), `common` (its language's word counts).

    A class is counted by what its removal takes from the text, so that the
    next one reads only what is left.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_classes(w: Column) -> Column:
        common = F.lit(None).cast("array<double>")
        for name, own in COMMON_WORDS.items():
            common = F.when(lang == name, word_counts(w, own)).otherwise(common)

        def taken(left: Column, patterns: list[tuple[str, str]], counts: dict[str, Column]) -> Column:
            if patterns:
                name, pattern = patterns[0]
                return let(F.regexp_replace(left, pattern + "+", ""), lambda rest: taken(rest, patterns[1:], counts | {name: F.length(left) - F.length(rest)}))
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                (F.length(text) - counts["space"]).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(left, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                F.array(*(c.cast("double") for c in counts.values()), F.length(left).cast("double")).alias("classes"),
                common.alias("common"),
            )

        return taken(text, list(CLASSES.items()), {})

    return let(words_of(text), of_classes)


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram from reference shares; 0 for an empty one."""

    def of_total(total: Column) -> Column:
        def term(x: Column, q: Column) -> Column:
            p = x / total
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

        whole = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.sqrt(F.greatest(whole / 2, F.lit(0.0)))).otherwise(0.0)

    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), of_total)


def references(counted: DataFrame, lang: str, measured: str) -> dict[str, tuple[list[float], list[float]]]:
    """Character-class and common-word shares of each language of COMMON_WORDS, summed over all rows.

    The driver gets one row per language of the parameter, other languages together.
    """
    n, m = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get(f"{measured}.classes", F.lit(k))).alias(f"c{k}") for k in range(n)] + [F.sum(F.get(f"{measured}.common", F.lit(k))).alias(f"w{k}") for k in range(m)]
    share = lambda v: [x / max(1.0, sum(v)) for x in v]
    own = lambda r: len(COMMON_WORDS.get(r[0], [])) + 1
    return {r[0]: (share(r[1 : n + 1]), share([x or 0.0 for x in r[n + 1 : n + 1 + own(r)]])) for r in counted.groupBy(lang).agg(*sums).collect()}


def rate(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS, out: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """docs, or `columns` of it, with a struct column `out`: BASE, base_failed, char_distance, word_distance, kept.

    A null or empty text has no words, and fails the base rules; an unknown or
    null language is judged by characters alone, against all such texts
    together. Long texts are read whole. Repeated rows are rated alike; no rows
    give none. A column named as `out` is replaced, others are left as they are.
    """
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    known = F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(""))
    own, m = private(docs, "own", "m")
    names = [c for c in (columns or docs.columns) if c.lower() != out.lower()]
    counted = stored(docs.select(*names, known.alias(own), measures(text, lang).alias(m)))
    classes, words = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    for name, (of_classes, of_words) in sorted(references(counted, own, m).items()):
        classes = F.when(F.col(own) == name, F.array(*map(F.lit, of_classes))).otherwise(classes)
        if name:
            words = F.when(F.col(own) == name, F.array(*map(F.lit, of_words))).otherwise(words)
    b = F.col(m)
    judged = b["n_words"] >= min_words
    failed = (b["n_words"] < 10) | (100 * b["n_repeat_words"] > 20 * b["n_words"])
    far = F.when(judged, distance(b["classes"], classes)).otherwise(0.0)
    odd = F.when(judged & (F.col(own) != ""), distance(b["common"], words)).otherwise(0.0)

    def verdict(d: Column) -> Column:
        kept = ~failed & (~judged | ((d["c"] <= char_limit) & (d["w"] <= word_limit)))
        return F.struct(*(b[c].alias(c) for c in BASE), failed.alias("base_failed"), d["c"].alias("char_distance"), d["w"].alias("word_distance"), kept.alias("kept"))

    return counted.select(*names, let(F.struct(far.alias("c"), odd.alias("w")), verdict).alias(out))
