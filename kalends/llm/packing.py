"""Packing documents into fixed-length sequences: cutting stock by column generation.

Documents longer than a sequence are cut into full sequences and a remainder.
The histogram of piece lengths, in classes of `unit` tokens, is the demand of a
cutting-stock problem. Its linear program starts from one-class patterns; a
knapsack dynamic program prices new columns against the duals until none helps
or the bound is within `gap`. Whole multiples of the patterns are used as they
are, the fractional rest is packed by best fit. The plan has at most a few
thousand rows whatever the corpus, so it travels in the task closure; ranks of
pieces within their class are found by salted counts, and each rank has its
slot in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, slices
from .encoder import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one class and salt are ranked in one task: about so many rows at most.
SALT_ROWS = 20_000


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, unit: int = 8, gap: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset (gapless from 0 in its sequence).

    A document is its ids without special tokens and then end_id; null and empty
    texts are end_id alone. Repeated rows are packed as often as they come, a
    null id stays null, no rows give none, other columns are left out.
    """
    cuts = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    lengths = np.array([tuple(r) for r in cuts.groupBy("length").count().collect()], np.int64).reshape(-1, 2)
    return assign(cuts, Plan(lengths[:, 0], lengths[:, 1], capacity, unit, gap))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches):
            ids, counts = own.encode(batch.column(1))
            raw, ends, out = memoryview(ids).cast("B"), counts.cumsum(), []
            tail = np.array([end_id], "<u4").tobytes()
            for doc, end, n in zip(batch.column(0).to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                first = end - n
                for start in range(0, n + 1, capacity):
                    stop = min(start + capacity, n + 1)
                    crc = zlib.crc32(raw[4 * (first + start) : 4 * (first + min(stop, n))])
                    out.append((doc, start, stop - start, zlib.crc32(tail, crc) if stop > n else crc, n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class Plan:
    """Patterns of length classes and how often each is used.

    slots[c] lists for class c, by first rank: the rank, the pattern's first
    sequence, its pieces of class c, and their first place in the sequence.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, unit: int, gap: float):
        self.unit, self.size = unit, capacity // unit
        demand = np.zeros(self.size + 1, np.int64)
        np.add.at(demand, -(-lengths // unit), counts)
        self.widths = np.flatnonzero(demand)
        need = demand[self.widths]
        uses: list[tuple[np.ndarray, int]] = []
        if len(need):
            patterns, amount = column_generation(self.widths, need, self.size, gap)
            whole = np.floor(amount + 1e-9).astype(np.int64)
            # rounding errors must not give a class more slots than it has pieces
            for j in np.flatnonzero(whole):
                used = patterns[:, j]
                n = int(min(whole[j], (need[used > 0] // used[used > 0]).min()))
                if n:
                    uses.append((used, n))
                    need = need - used * n
            uses += [(p, 1) for p in best_fit(self.widths, need, self.size)]
        self.slots: dict[int, np.ndarray] = {}
        rank, sequence, slots = np.zeros(len(self.widths), np.int64), 0, {int(w): [] for w in self.widths}
        for used, n in uses:
            place = 0
            for i in np.flatnonzero(used)[::-1]:  # the longest first
                slots[int(self.widths[i])].append((rank[i], sequence, used[i], place))
                rank[i] += used[i] * n
                place += used[i]
            sequence += n
        self.slots = {w: np.array(s, np.int64) for w, s in slots.items()}

    def place(self, width: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place in it of a class's pieces by rank from 0."""
        table = self.slots[width]
        row = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
        at = rank - row[:, 0]
        return row[:, 1] + at // row[:, 2], row[:, 3] + at % row[:, 2]


def knapsack(widths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The best value of pieces that fit, and how many of each: one row of the dynamic program per capacity."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    for c in range(1, size + 1):
        n = np.searchsorted(widths, c, side="right")
        best[c] = best[c - 1]
        if n:
            gain = best[c - widths[:n]] + values[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    used, c = np.zeros(len(widths), np.int64), size
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            used[took[c]] += 1
            c -= widths[took[c]]
    return float(best[size]), used


def column_generation(widths: np.ndarray, need: np.ndarray, size: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, their amounts): a basis of the linear program, within `gap` of its optimum."""
    m = len(widths)
    patterns = np.diag(size // widths)
    inverse = np.diag(1.0 / (size // widths))
    amount = inverse @ need
    for _ in range(20 * m + 100):
        duals = inverse.sum(axis=0)
        value, column = knapsack(widths, duals, size)
        if value <= 1 + 1e-9 or value - 1 <= gap:  # total / value bounds the optimum from below
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
    else:
        raise RuntimeError(f"column generation did not come within {gap} of its bound: {value - 1}")
    return patterns, amount


def best_fit(widths: np.ndarray, need: np.ndarray, size: int) -> list[np.ndarray]:
    """Patterns for what the rounding left: the longest first, each into the fullest sequence with room."""
    open_: list[list[np.ndarray]] = [[] for _ in range(size + 1)]  # by room
    for i in range(len(widths) - 1, -1, -1):
        for _ in range(int(need[i])):
            room = next((r for r in range(int(widths[i]), size) if open_[r]), size)
            used = open_[room].pop() if open_[room] else np.zeros(len(widths), np.int64)
            used[i] += 1
            open_[room - int(widths[i])].append(used)
    return [p for row in open_[: size] for p in row]


def assign(cuts: DataFrame, plan: Plan) -> DataFrame:
    n = cuts.count()
    width = F.ceil(F.col("length") / plan.unit).cast("int")
    salts = max(1, -(-n // SALT_ROWS))
    rows = cuts.withColumn("width", width).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("width").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("width", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("width", "salt").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = rows.withColumn("own", F.row_number().over(order) - 1).join(counts, ["width", "salt"]).withColumn("rank", F.col("before") + F.col("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, rank = batch.column("width").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(widths):
                own = widths == w
                sequence[own], place[own] = plan.place(int(w), rank[own])
            kept = [batch.column(c) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(place)], names=[*COLUMNS, "sequence_id", "place"])

    placed = ranked.select(*COLUMNS, "width", "rank").mapInArrow(run, f"{PIECES}, sequence_id long, place long")
    # a sequence has at most `capacity` pieces
    sofar = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(sofar), F.lit(0))).drop("place")


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
