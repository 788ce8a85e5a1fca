import math
import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa

from kalends.llm import line_crf
from kalends.llm.line_crf import Field, Lines, classify, fit, rate_documents


def marginals(x, weights, pairs):
    """By all labellings of the lines."""
    score = lambda y: sum((1 if v else -1) * float(r @ weights) / 2 for r, v in zip(x, y, strict=True)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False))
    every = [(y, math.exp(score(y))) for y in product([0, 1], repeat=len(x))]
    total = sum(p for _, p in every)
    good = [sum(p for y, p in every if y[t]) / total for t in range(len(x))]
    joint = np.zeros((2, 2))
    for y, p in every:
        for a, b in zip(y, y[1:], strict=False):
            joint[a, b] += p / total
    return good, joint


def test_messages_equal_all_labellings():
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(6), [1, 3, 7, 2, 1, 6])
    lines = Lines.arranged(doc, np.ones(len(doc)), rng.standard_normal((len(doc), 3)))
    field = Field(rng.standard_normal(12), rng.standard_normal((2, 2)), np.zeros(12), np.ones(12))
    x = field.scaled(lines)
    good, joint = field.marginals(lines, x, True)
    want = [marginals(x[doc == d], field.weights, field.pairs) for d in range(6)]
    assert np.allclose(good, np.concatenate([w[0] for w in want]))
    assert np.allclose(joint, sum(w[1] for w in want))


def test_features_of_lines():
    texts = ["", None, "abc DEF 12!\n\nof of of", "é#\n", "\n", "one two three four five\nsix one two three four five", "same line here\nsame line here", "same line here"]
    lines = Lines.of(pa.array(texts))
    assert lines.doc.tolist() == [d for d, t in enumerate(texts) for _ in (t or "").split("\n")]
    rows = [x for t in texts for x in (t or "").split("\n")]
    assert lines.weight.tolist() == [len(x.encode()) + 1 for x in rows]
    for x, row in zip(rows, lines.x, strict=True):
        for k, chars in enumerate(line_crf.CLASSES):
            assert math.isclose(row[k], sum(c in chars for c in x) / (len(x.encode()) + 1))
    again, covered, same = lines.x[:, -3], lines.x[:, -2], lines.x[:, -1]
    assert again.tolist() == [2 / 3 if x == "of of of" else 0 for x in rows]
    assert covered.tolist() == [0] * 9 + [1, 5 / 6, 0, 0, 0]
    assert same.tolist() == [0] * 11 + [1, 1, 0]


def test_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(line_crf, "PART", 7)
    data = np.frombuffer(b"word other word a b a longerthanseven x longerthanseven longerthanseve", np.uint8)
    starts = np.flatnonzero((data != 32) & np.r_[True, data[:-1] == 32])
    stops = np.r_[np.flatnonzero(data == 32), len(data)]
    h, words = line_crf.hashes(data, starts, stops), bytes(data).split()
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def corpus(n, seed=1):
    rng = random.Random(seed)
    low = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    rows = []
    for i in range(n):
        words = [low(rng.randint(1, 8)) for _ in range(rng.randint(5, 60))]
        good = rng.random() < 0.7
        if not good:
            words = [w + "$$$" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(4)]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    extra = [(1000, None, None), (1001, "", None), (1002, "a line\n" * 20_000 + "x" * 100_000, None), (None, "no id", None), (3, rows[3][1], None), (3, rows[3][1], None)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows + extra], "doc_id long, text string, score double, id string")
    labels = spark.createDataFrame([(i, q, 1) for i, _, q in rows if i % 5] + [(None, 1, 1), (7777, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = rate_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    own = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [(own[i].predicted == q) for i, _, q in rows if own[i].held_out]
    assert len(tested) > 150 and sum(tested) / len(tested) > 0.97
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in rows if i % 5], "doc_id long, quality int")
    assert {(r.doc_id, r.score) for r in rate_documents(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    kept = classify(docs, fit(docs, labels)).collect()
    assert [r for r in kept if r.doc_id == 1][0].id == "x" and kept[0].asDict().keys() == {"doc_id", "text", "score", "id"}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text\nof lines"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in rate_documents(docs, labels).collect()] == [0.5, 0.5]
    assert rate_documents(docs.limit(0), labels).collect() == []
