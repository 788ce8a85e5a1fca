import zlib

import numpy as np
from tokenizers import Tokenizer

from kalends.llm.encoder import public
from kalends.llm.packing import Plan, pack


def test_plan_covers_the_demand_with_little_padding():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(1 + rng.gamma(1.5, 600, 40_000).astype(int), 4096), return_counts=True)
    plan = Plan(lengths, counts, 4096, 8, 0.002)
    widths = -(-lengths // 8)
    filled: dict[int, int] = {}
    for w in np.unique(widths):
        sequence, place = plan.place(int(w), np.arange(counts[widths == w].sum()))
        assert len(set(zip(sequence.tolist(), place.tolist(), strict=True))) == len(sequence)
        for s in sequence.tolist():
            filled[s] = filled.get(s, 0) + int(w)
    assert max(filled.values()) <= 512
    assert len(filled) * 4096 < 1.02 * (lengths * counts).sum()


def fewest(pieces: list[int], size: int) -> int:
    """The least number of sequences, by trying every place for the longest piece first."""
    best = len(pieces)

    def go(k: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for r in sorted({*rooms}):
            if r >= pieces[k]:
                i = rooms.index(r)
                go(k + 1, [*rooms[:i], r - pieces[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, size - pieces[k]])

    pieces = sorted(pieces, reverse=True)
    go(0, [])
    return best


def test_plans_are_near_the_least_number_of_sequences():
    rng = np.random.default_rng(3)
    for _ in range(40):
        size = int(rng.integers(8, 30))
        pieces = rng.integers(1, size + 1, int(rng.integers(1, 10)))
        lengths, counts = np.unique(pieces, return_counts=True)
        plan = Plan(lengths, counts, size, 1, 0.002)
        used = {int(s) for w, n in zip(lengths, counts, strict=True) for s in plan.place(int(w), np.arange(n))[0]}
        assert len(used) <= fewest(pieces.tolist(), size) + 1


def test_every_id_is_in_one_piece(spark, texts):
    library = Tokenizer.from_file(public("word_bpe_49k.json"))
    rows = [(1, "word " * 300), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (5, "x y " * 64), (None, "z")] + [(i, "tok " * (i % 37)) for i in range(10, 90)]
    got = pack(texts(rows), public("word_bpe_49k.json"), capacity=64, unit=4).collect()
    ids = sorted((i if i is not None else -1, *library.encode(t or "", add_special_tokens=False).ids, 2) for i, t in rows)
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r)
    for doc, *want in ids:
        if doc == 4:
            assert len(by_doc[4]) == 2
            continue
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens == len(want)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert pack(texts([]), public("word_bpe_49k.json")).count() == 0
