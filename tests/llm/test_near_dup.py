import random
from collections import Counter

import numpy as np
import pytest

from kalends.llm import common
from kalends.llm.line_dedup import dedup_lines, features, jaccard, shingles, signatures
from kalends.llm.near_dup import aligned, keep_one, near_duplicates, sketches, windows


def normal(line):
    return " ".join(line.lower().split())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def brute(texts):
    """Classes by similarity of all pairs, computed with plain dynamic programming."""
    x = [windows(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            a, b = x[i].tolist(), x[j].tolist()
            row = [0] * (len(b) + 1)
            for u in a:
                left = 0
                new = [0]
                for k, v in enumerate(b):
                    left = max(row[k + 1], left, row[k] + 1 if u == v else 0)
                    new.append(left)
                row = new
            if texts[i] == texts[j] or (a and b and row[-1] / (len(a) + len(b) - row[-1]) >= 0.8):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark, texts):
    rng = random.Random(3)
    data = []
    for size in (3, 12, 60, 120):
        base = prose(rng, size)
        data += [base] + [edited(rng, base, rng.randint(0, max(1, size // 30))) for _ in range(6)] + [prose(rng, size)]
    halves = data[-1].split()
    data += [" ".join(halves[60:] + halves[:60]), "", "", None, "  ", "one two", "the same " * 40, "the same " * 39]
    rng.shuffle(data)
    got = near_duplicates(texts(list(enumerate(data)))).collect()
    want = brute([t or "" for t in data])
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    assert {r.doc_id: r.class_size for r in got} == {i: want.count(w) for i, w in enumerate(want)}
    kept = keep_one(texts(list(enumerate(data)) + [(None, "x")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want))
    assert kept.columns == ["doc_id", "text", "n_tokens"]
    assert near_duplicates(texts([])).collect() == []


def test_alignment_respects_order():
    a = np.arange(100, dtype=np.uint64)
    assert aligned(a, a) == 1
    assert aligned(a, np.r_[a[50:], a[:50]]) < 0.8
    assert aligned(a, a[:81]) >= 0.8 > aligned(a, a[:79])


def test_lines_equal_brute_force(spark, texts):
    rng = random.Random(5)
    base = [prose(rng, 30) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) if rng.random() < 0.6 else prose(rng, 25) for _ in range(rng.randint(0, 5))]
        rows.append((i, "\n".join([*lines, "short line", "  TAB\tand  blank " + base[i % 12] + " "][: 5 if i % 3 else 9])))
    rows += [(50, None), (51, ""), (52, rows[3][1]), (None, rows[4][1])]
    got = {r.doc_id: r for r in dedup_lines(texts(rows)).collect()}
    places = sorted((d if d is not None else -1, i, normal(x)) for d, t in rows if t for i, x in enumerate(t.split("\n")) if normal(x))
    root = list(range(len(places)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(places)):
        for j in range(i):
            if jaccard(shingles(places[i][2]), shingles(places[j][2])) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    gone = {places[i][:2] for i in range(len(places)) if find(i) != i}
    for d, t in rows:
        r = got[d]
        want = None if t is None else [x for i, x in enumerate(t.split("\n")) if (d if d is not None else -1, i) not in gone]
        assert r.text == (None if t is None else "\n".join(want))
        assert (r.n_lines, r.n_removed) == ((0, 0) if t is None else (len(t.split("\n")), len(t.split("\n")) - len(want)))
    assert dedup_lines(texts([])).collect() == []


@pytest.mark.parametrize("members", [512, 8])
def test_lines_of_a_template_whose_source_is_absent_equal_brute_force(spark, texts, monkeypatch, members):
    monkeypatch.setattr(common, "MEMBERS", members)  # larger buckets go in groups and rounds
    monkeypatch.setattr(common, "LEADERS", 2)
    rng = random.Random(17)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    lines = set()
    while len(lines) < 150:
        line = list(base)
        for _ in range(rng.randint(2, 4)):
            line[rng.randrange(300)] = rng.choice("ijklmnop")
        lines.add(normal("".join(line)))
    lines = sorted(lines, key=lambda x: rng.random())
    root = list(range(len(lines)))
    find = lambda i: i if root[i] == i else find(root[i])
    # equal to the operator's own candidates: pairs that share a band, all verified
    keys = [set(k.tolist()) for k in signatures(lines)]
    assert max(Counter(x for k in keys for x in k).values()) > 8
    for i in range(len(lines)):
        for j in range(i):
            if keys[i] & keys[j] and jaccard(shingles(lines[i]), shingles(lines[j])) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id for r in dedup_lines(texts(list(enumerate(lines)))).collect() if not r.n_removed}
    assert got == {find(i) for i in range(len(lines))}


@pytest.mark.parametrize("members", [512, 8])
def test_texts_whose_source_is_absent_are_whole_classes(spark, texts, monkeypatch, members):
    monkeypatch.setattr(common, "MEMBERS", members)
    monkeypatch.setattr(common, "LEADERS", 2)
    rng = random.Random(23)
    base = prose(rng, 300)
    data = [edited(rng, base, rng.randint(3, 5)) for _ in range(100)]
    x = [windows(t) for t in data]
    keys = [set(sketches(w).tolist()) for w in x]
    assert max(Counter(v for k in keys for v in k).values()) > 8
    root = list(range(len(data)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(data)):
        for j in range(i):
            if keys[i] & keys[j] and aligned(x[i], x[j]) >= 0.8:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r.class_id for r in near_duplicates(texts(list(enumerate(data)))).collect()}
    assert got == {i: find(i) for i in range(len(data))}


def test_texts_of_a_repeated_id_are_told_apart(spark, texts):
    rng = random.Random(29)
    one, other = prose(rng, 80), prose(rng, 80)
    near_one, near_other = edited(rng, one, 1), edited(rng, other, 1)
    rows = [(1, one), (1, other), (1, one), (2, near_one), (3, near_other), (4, prose(rng, 80))]
    assert sorted((r.doc_id, r.text) for r in keep_one(texts(rows)).collect()) == sorted({(1, one), (1, other), rows[5]})
    assert {(r.doc_id, r.class_id, r.class_size) for r in near_duplicates(texts(rows)).collect()} == {(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 4, 1)}


@pytest.mark.parametrize("length", [30, 100, 130, 400])
def test_lines_at_the_threshold_share_a_band(length):
    rng = random.Random(length)
    pairs = []
    while len(pairs) < 300:
        line = "".join(rng.choice("abcdefgh ") for _ in range(length))
        k = rng.randrange(1, max(2, length // 8))
        other = line[:-k] if rng.random() < 0.5 else "".join(rng.choice("xyz") for _ in range(k)) + line[k:]
        if 0.8 <= jaccard(shingles(line), shingles(other)) < 0.9:
            pairs.append((line, other))
    left, right = (signatures([p[side] for p in pairs]) for side in (0, 1))
    assert (left == right).any(axis=1).mean() >= 0.98


@pytest.mark.parametrize("size", [20, 60, 300])
def test_texts_at_the_threshold_share_a_sketch(size):
    rng = random.Random(size)
    found = []
    while len(found) < 150:
        words = prose(rng, size).split()
        k = max(1, rng.randrange(max(2, size // 9)))
        x, y = windows(" ".join(words)), windows(" ".join(words[k:] if rng.random() < 0.5 else words[: size - k] + prose(rng, k // 2 + 1).split()))
        if 0.8 <= aligned(x, y) < 0.92:
            found.append(bool(set(sketches(x).tolist()) & set(sketches(y).tolist())))
    assert np.mean(found) >= 0.98


def test_candidates_are_those_of_all_pairs():
    rng = random.Random(31)
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    lines = []
    for _ in range(40):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(120)] = rng.choice("ijkl")
        lines.append("".join(line))
    lines += ["x", "short", "x" * 50]
    leaders = [k for k in range(len(lines)) if k % 3]
    sets = [shingles(x) for x in lines]
    for size in (32_000_000, 2000):
        common.TABLE_BYTES, before = size, common.TABLE_BYTES
        got = common._candidates(features(lines), leaders, 0.8)
        common.TABLE_BYTES = before
        assert got == [[j for j in leaders if jaccard(sets[k], sets[j]) >= 0.8] for k in range(len(lines))]
