"""Exact similarity of lines by whole numbers, which costs less than by sets of texts."""

import random
import time

import numpy as np

from kalends.llm.line_dedup import SHINGLE, jaccard, numbered_shingles, shingles, similarity, texts


def test_numbered_shingles_are_exact():
    rng = random.Random(3)
    lines = ["", "a", "short", "x" * 40, "\x00" * 9, "ÿ" * 8 + "\x00"]
    for alphabet in ("ab", "abcdefghij é", "aéя", "ab\U0001f600"):
        lines += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(12)]
    known = [numbered_shingles(x) for x in lines]
    assert all(texts(v) == shingles(x) and len(v) == len(shingles(x)) for x, v in zip(lines, known, strict=True))
    assert {isinstance(v, np.ndarray) for v in known} == {True, False} and SHINGLE == 8
    for x, v in zip(lines, known, strict=True):
        for y, w in zip(lines, known, strict=True):
            for threshold in (0.0, 0.8):
                assert similarity(v, w, threshold) == jaccard(shingles(x), shingles(y), threshold)


def test_numbered_shingles_cost_less_than_sets():
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefghijklmnop ", k=600)) for _ in range(300)]

    def seconds(prepare, alike):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            known = [prepare(x) for x in lines]
            for v, w in zip(known, known[1:], strict=False):
                alike(v, w, 0.8)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(numbered_shingles, similarity) < 0.7 * seconds(shingles, jaccard)
