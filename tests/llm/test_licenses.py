import random
from functools import cache

from kalends.llm.licenses import COVERAGE, TEMPLATES, Template, best_finds, patience, scan, scan_licenses, words


def longest(a, b):
    @cache
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return go(i + 1, j + 1) + 1 if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def plain(a, b):
    """Patience alignment by its definition, with all chains of anchors tried: the aligned pairs."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*plain(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    best = [[] for _ in once]
    for k, (i, j) in enumerate(once):
        best[k] = max((best[m] for m in range(k) if once[m][1] < j), key=len, default=[]) + [(i, j)]
    chain = max(best, key=len, default=[])
    if not chain:
        return []
    out, last = [], (-1, -1)
    for i, j in [*chain, (len(a), len(b))]:
        out += [(p + last[0] + 1, q + last[1] + 1) for p, q in plain(a[last[0] + 1 : i], b[last[1] + 1 : j])]
        out += [(i, j)] if i < len(a) else []
        last = (i, j)
    return out


def test_patience_is_an_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))]
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:], strict=False))
        assert len(got) <= longest(tuple(a), tuple(b))
        if len(set(a)) == len(a) and sorted(a) == sorted(b):
            assert len(got) == longest(tuple(a), tuple(b)) == len(plain(a, b))


def test_finds_equal_brute_force():
    rng = random.Random(4)
    n_found = n_none = 0
    for _ in range(150):
        own = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("123") for _ in range(rng.randint(5, 14))]
        template = Template(" ".join(own), tuple(rng.sample(own, rng.choice([0, 0, 1]))))
        text = [f"n{k}" for k in range(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 2)):
            copy = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else rng.choice(["odd", rng.choice(own)]) for w in own]
            text += copy + [f"m{k}" for k in range(rng.randint(len(own), 20))]
        found = scan(text, template)
        for a, b, m in found:
            pairs = plain(text[a:b], own)
            assert m >= COVERAGE * len(own) - 1e-9 and longest(tuple(text[a:b]), tuple(own)) >= m
            assert set(template.must) <= {own[j] for _, j in pairs} or len(pairs) != m
        # every window of the template's length that is covered meets a find
        for a in range(len(text)):
            pairs = plain(text[a : a + len(own)], own)
            if len(pairs) >= COVERAGE * len(own) - 1e-9 and set(template.must) <= {own[j] for _, j in pairs}:
                assert any(x < a + len(own) and a < y for x, y, _ in found), (own, text, a)
                n_found += 1
            else:
                n_none += 1
    assert n_found > 50 and n_none > 500


def test_every_template_is_found_in_itself_and_with_edits():
    rng = random.Random(1)
    noise = [f"n{i}" for i in range(500)]
    for name, template in TEMPLATES.items():
        own = template.words
        assert scan(own, template) == [(0, len(own), len(own))]
        assert best_finds(own, TEMPLATES) == [(name, (0, len(own), len(own)))]
        both = noise[:200] + own + noise[200:300] + own + own + noise[300:]
        starts = [200, 300 + len(own), 300 + 2 * len(own)]
        assert scan(both, template) == [(s, s + len(own), len(own)) for s in starts]
        if len(own) > 20:
            cut = [w for w in own if w in template.must or rng.random() > 0.1]
            assert len(scan(noise[:50] + cut + noise[50:], template)) == 1


def test_the_right_license_is_named():
    name = lambda text: [x for x, _ in best_finds(words(text), TEMPLATES)]
    assert name("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]
    assert name("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert name("Licensed under the Apache License, Version 1.1") == ["Apache-1.1"]
    assert name("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert name("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert name(TEMPLATES["MIT-text"].text.replace("Permission", "Permision").replace("sublicense", "sub-licence")) == ["MIT-text"]
    assert name("the mit of apache version 2.0 was licensed") == []


def test_long_texts_of_template_words(spark, texts):
    many = " ".join(["software"] * 20_000 + ["gnu", "license"] * 5_000)
    rows = [(1, many), (2, many + " " + TEMPLATES["MIT-text"].text)]
    got = [(r.doc_id, r.license, r.start_word) for r in scan_licenses(texts(rows)).collect()]
    assert got == [(2, "MIT-text", 30_000)]


def test_columns(spark, texts):
    rows = [(1, "x y. Released under the MIT License.\nmore"), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (4, "mit apache gnu cc permission"), (1, "Released under the MIT License.")]
    got = sorted(((r.doc_id or -1, r.license, r.start_word, r.end_word, r.coverage) for r in scan_licenses(texts(rows)).collect()))
    assert got == [(-1, "CC-BY-NC-4.0", 0, 6, 1.0), (1, "MIT", 0, 5, 1.0), (1, "MIT", 2, 7, 1.0)]
    assert scan_licenses(texts([])).collect() == []
