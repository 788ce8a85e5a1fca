import math
import random
import re

from kalends.llm.quality import BASE, COMMON_WORDS, rate


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), n < 10 or 100 * len(repeat) > 20 * n


def classes(text):
    kinds = [str.islower, str.isupper, str.isdecimal, lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in ".,;:!?'\"()-"]
    out = [sum(map(k, text)) for k in kinds]
    return [*out, len(text) - sum(out)]


def common(text, words):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    out = [w.count(x) for x in words]
    return [*out, len(w) - sum(out)]


def js(p, q):
    if not sum(p):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / max(1, sum(q)) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_equals_brute_force(spark):
    rng = random.Random(6)
    word = lambda lang: rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice("aeioußnt") for _ in range(5))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(2 * i + (lang == "fr") + 200, lang, prose(lang, rng.randint(5, 200)) + rng.choice(["", "\n", "\nline one here\nline one here", "\t. ,"])) for i in range(40) for lang in ["en", "fr"]]
    rows += [(100, "en", " ".join(["### $$$ %%%"] * 3 + ["a|b|%d" % i for i in range(150)])), (101, None, prose("de", 90)), (102, "xx", "1234 5678 " * 60), (103, "en", None), (104, "en", ""), (105, "en", "a b c d e"), (106, "en", "a b c d e " * 30), (106, "en", "a b c d e " * 30)]
    rows += [(107, "en", "x y z w v u\x0bx y z w v u t"), (108, "en", "word " * 3000), (109, "en", "the the the of")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, n_words string")
    got = {r.doc_id: r for r in rate(df).collect()}
    sums = {}
    for _, lang, text in rows:
        known = lang if lang in COMMON_WORDS else ""
        c, w = sums.setdefault(known, ([0] * 6, [0] * 13))
        for total, more in ((c, classes(text or "")), (w, common(text or "", COMMON_WORDS[known]) if known else [0] * 13)):
            for k, v in enumerate(more):
                total[k] += v
    for i, lang, text in rows:
        q = got[i].quality
        want = base(text)
        assert tuple(q[c] for c in [*BASE, "base_failed"]) == want, i
        known = lang if lang in COMMON_WORDS else ""
        c, w = (js(classes(text), sums[known][0]), js(common(text, COMMON_WORDS[known]), sums[known][1]) if known else 0.0) if want[0] >= 80 else (0, 0)
        assert abs(q.char_distance - c) < 1e-6 and abs(q.word_distance - w) < 1e-6
        assert q.kept == (not want[5] and (want[0] < 80 or (c <= 0.25 and w <= 0.26)))
        assert got[i].n_words == "x"
    assert not got[100].quality.kept
    assert rate(df.limit(0)).collect() == []
