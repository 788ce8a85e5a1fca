"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of its characters by
class and of its words that are short, repeat the one before, or stand in
five-word windows that the text repeats; the two neighbouring lines' features
count besides. The field adds a weight for each pair of neighbouring lines'
labels. Forward-backward gives each line's probability of being good, and their
mean, weighted by length, is the document's score.

Weights are fitted on the `SAMPLE` labelled documents of least hashed id with
up to `SAMPLE_LINES` lines (so the driver gets a bounded number of feature
rows, and no texts), whose lines all have their document's label. Every text is
scored whole.

Forward and backward messages are products of 2 x 2 matrices, a line each. They
are made for all lines of a batch together by doubling: after k steps a line's
matrix spans the 2 ** k lines up to it, so a text of very many lines needs no
loop over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private, sampled, slices

#: Documents, and lines of each, that weights are fitted on; rounds, step and ridge of the fit.
SAMPLE, SAMPLE_LINES, ROUNDS, STEP, RIDGE = 4096, 128, 80, 0.1, 1e-3
#: Words of a window, and bytes of a short word.
WINDOW, SHORT = 5, 3
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", ".,;:'\"()-?", "!", "#$%&*|<>", "/\\_=+@[]{}^~`"]
FEATURES = len(CLASSES) + 7
#: A factor of rolling hashes, odd so that it has an inverse, and bytes hashed at a time.
FACTOR, PART = 0x9E3779B97F4A7C15, 1 << 20
LINES = "doc long, line int, weight double, x binary"


def _table() -> np.ndarray:
    """Each byte's class: those of CLASSES, then newlines, other bytes, and bytes beyond ASCII."""
    out = np.full(256, len(CLASSES) + 1, np.uint8)
    for k, chars in enumerate(CLASSES):
        out[list(chars.encode())] = k
    out[10] = len(CLASSES)
    out[128:] = len(CLASSES) + 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of data[start:stop] for each; both arrays ascend."""
    whole, inverse = powers(FACTOR, PART + 1), powers(pow(FACTOR, -1, 1 << 64), PART + 1)
    at = [np.zeros(len(x), np.uint64) for x in (starts, stops)]
    back = np.zeros(len(starts), np.uint64)
    total, scale, unscale = np.uint64(0), np.uint64(1), np.uint64(1)
    for lo in range(0, len(data) + 1, PART):
        part = data[lo : lo + PART]
        sums = np.concatenate([[total], total + np.cumsum((part + np.uint64(1)) * whole[: len(part)] * scale, dtype=np.uint64)])
        for x, out in zip((starts, stops), at, strict=True):
            i, j = np.searchsorted(x, [lo, lo + PART])
            out[i:j] = sums[x[i:j] - lo]
            if x is starts:
                back[i:j] = inverse[x[i:j] - lo] * unscale
        with np.errstate(over="ignore"):  # products are those modulo 2 ** 64
            total, scale, unscale = sums[-1], scale * whole[PART], unscale * inverse[PART]
    return mixed((at[1] - at[0]) * back)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(FACTOR)
    return x ^ (x >> np.uint64(29))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.empty(len(keys), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out


@dataclass(frozen=True)
class Lines:
    """doc, place (from 0) and length of each line in order, and its own features."""

    doc: np.ndarray
    place: np.ndarray
    left: np.ndarray
    weight: np.ndarray
    x: np.ndarray

    @staticmethod
    def arranged(doc: np.ndarray, weight: np.ndarray, x: np.ndarray) -> Lines:
        """left: lines of the document that follow."""
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.intp)
        sizes = np.diff(np.r_[heads, len(doc)])
        place = np.arange(len(doc)) - np.repeat(heads, sizes)
        return Lines(doc, place, np.repeat(sizes, sizes) - 1 - place, weight, x)

    @staticmethod
    def of(texts: pa.Array) -> Lines:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
        data = np.insert(data, offsets[1:] - offsets[0], 10)  # a newline ends each text's last line
        ends = offsets[1:] - offsets[0] + np.arange(1, len(texts) + 1)
        kinds = _table()[data]
        stops = np.flatnonzero(data == 10) + 1
        starts = np.r_[0, stops[:-1]]
        doc = np.searchsorted(ends, stops, side="left")
        size = (stops - starts).astype(float)
        share = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / size for k in range(len(CLASSES))]
        share.append(np.add.reduceat(kinds == len(CLASSES) + 2, starts, dtype=np.int64) / size)
        blank = (kinds == CLASSES.index(" \t\x0b\x0c\r")) | (data == 10)
        first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        last = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        line = np.searchsorted(stops, first, side="right")
        words = np.bincount(line, minlength=len(stops)).astype(float)
        of_words = lambda flags: np.bincount(line, flags, len(stops)) / np.maximum(words, 1)
        h = hashes(data, first, last)
        own = doc[line] if len(line) else np.empty(0, np.intp)
        again = np.r_[False, (h[1:] == h[:-1]) & (own[1:] == own[:-1])][: len(h)]
        n = max(0, len(h) - WINDOW + 1)
        windows = np.flatnonzero(own[:n] == own[len(h) - n :])  # starts of those within a text
        key = mixed(own[windows].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            key = mixed(key + h[windows + k])
        twice, covered = windows[repeated(key)], np.zeros(len(h), bool)
        for k in range(WINDOW):
            covered[twice + k] = True
        same_line = repeated(hashes(data, starts, stops) + mixed(doc.astype(np.uint64) + np.uint64(1))) & (words > 0)
        x = np.column_stack([*share, np.log1p(size), of_words(last - first) / 8, of_words(last - first <= SHORT), of_words(again), of_words(covered), same_line])
        return Lines.arranged(doc, size, x)

    def with_neighbours(self) -> np.ndarray:
        """x of the line, of the one before and of the one after, and whether there are such."""
        before, after = np.roll(self.x, 1, axis=0), np.roll(self.x, -1, axis=0)
        head, tail = self.place == 0, self.left == 0
        before[head], after[tail] = 0, 0
        return np.column_stack([self.x, before, after, head, tail, np.ones(len(self.x))])


def times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, scaled to a sum of 1; arrays (row, column, line)."""
    out = p[:, 0, None] * q[None, 0] + p[:, 1, None] * q[None, 1]
    return out / out.sum(axis=(0, 1))


@dataclass
class Field:
    """weights of a good line's features, pair weights [label before, label] and the features' centre and scale."""

    weights: np.ndarray
    pairs: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scaled(self, lines: Lines) -> np.ndarray:
        return np.clip((lines.with_neighbours() - self.centre) / self.scale, -8, 8)

    def marginals(self, lines: Lines, x: np.ndarray, pairwise: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good; and the sum of neighbouring lines' joint ones, if asked for."""
        e = np.exp(np.clip(x @ self.weights, -30, 30) / 2)
        step = np.exp(self.pairs)[:, :, None] * np.stack([1 / e, e])
        step = np.where(lines.place == 0, np.stack([1 / e, e]), step)
        step = step / step.sum(axis=(0, 1))
        n, span = len(e), 1
        ahead = step.copy()
        behind = np.where(lines.left == 0, np.eye(2)[:, :, None], np.roll(step, -1, axis=2))
        while span <= (lines.place.max() if n else 0):
            at = np.flatnonzero(lines.place >= span)
            ahead[:, :, at] = times(ahead[:, :, at - span], ahead[:, :, at])
            # a line's product spans its next lines; at the document's end it's already whole
            at = np.flatnonzero(lines.left >= span)
            behind[:, :, at] = times(behind[:, :, at], behind[:, :, at + span])
            span *= 2
        alpha, beta = ahead[0], behind.sum(axis=1)
        good = alpha[1] * beta[1] / (alpha * beta).sum(axis=0)
        joint = np.zeros((2, 2))
        if pairwise:
            at = np.flatnonzero(lines.place > 0)
            both = alpha[:, None, at - 1] * step[:, :, at] * beta[None, :, at]
            joint = (both / both.sum(axis=(0, 1))).sum(axis=2)
        return good, joint

    @staticmethod
    def fit(lines: Lines, good: np.ndarray) -> Field:
        """good: each line's label. The likelihood's gradient is what is seen less what is expected; steps are those of Adam."""
        x = lines.with_neighbours()
        if not len(x):
            return Field(np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]))
        scale = x.std(axis=0)
        field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), np.where(scale > 0, x.mean(axis=0), 0), np.where(scale > 0, scale, 1))
        x, y = field.scaled(lines), good.astype(int)
        seen = np.zeros((2, 2))
        at = np.flatnonzero(lines.place > 0)
        np.add.at(seen, (y[at - 1], y[at]), 1)
        moment, square = 0.0, 0.0
        for k in range(1, ROUNDS + 1):
            p, joint = field.marginals(lines, x, True)
            gradient = np.r_[x.T @ (y - p), (seen - joint).ravel()] / max(1, len(y))
            gradient -= RIDGE * np.r_[field.weights, field.pairs.ravel()]
            moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
            change = STEP * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
            field.weights += change[:-4]
            field.pairs += change[-4:].reshape(2, 2)
        return field

    def score(self, lines: Lines, n: int) -> np.ndarray:
        """The n documents' length-weighted mean probabilities."""
        good, _ = self.marginals(lines, self.scaled(lines))
        return np.clip(np.bincount(lines.doc, good * lines.weight, n) / np.bincount(lines.doc, lines.weight, n), 0, 1)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field of a sample of labelled documents that aren't held out; without any, every line is as likely good as bad.

    An id with several labels is good if one of them is 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    least = known.select("*", F.xxhash64("id").alias("h")).where(sampled("h", 4 * SAMPLE, known.count()))
    places = least.orderBy("h", "id").limit(2 * SAMPLE).collect()  # a bounded sample; some ids may have no text, or too many lines
    marks = {r["id"]: int(r["quality"] == 1) for r in places}
    ids = docs.sparkSession.createDataFrame([(i,) for i in marks], "id long")
    some = own.join(F.broadcast(ids), "id", "left_semi").where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < SAMPLE_LINES)
    rows = some.repartition("id").mapInArrow(_featured, LINES).toPandas()
    chosen = {i for _, i in zip(range(SAMPLE), (i for i in marks if i in set(rows["doc"])), strict=False)}
    rows = rows[rows["doc"].isin(chosen)].sort_values(["doc", "line"], kind="stable")
    # repeated rows of an id: the first of each line
    rows = rows.drop_duplicates(["doc", "line"])
    x = np.frombuffer(b"".join(rows["x"]), float).reshape(-1, FEATURES)
    lines = Lines.arranged(rows["doc"].to_numpy(), rows["weight"].to_numpy(), x)
    return Field.fit(lines, np.array([marks[i] for i in rows["doc"]], int))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lines = Lines.of(batch.column("text"))
        ids = batch.column("id").to_numpy()[lines.doc]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines.place.astype(np.int32)), pa.array(lines.weight), pa.array([r.tobytes() for r in lines.x], pa.binary())], ["doc", "line", "weight", "x"])


def classify(docs: DataFrame, field: Field, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`, 0 to 1: how likely a text's lines are good, weighted by length.

    A null text is empty, which is one empty line; long texts are scored whole;
    repeated rows alike; no rows give none. A column named as `out` is
    replaced, others stay.
    """
    names = [c for c in docs.columns if c.lower() != out.lower()]
    (text,) = private(docs, "text_of_lines")
    given = docs.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    schema = docs.select(*names).schema.add(out, "double", False)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = field.score(Lines.of(batch.column(batch.schema.get_field_index(text))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*names, out])

    return given.mapInArrow(score, schema)


def rate_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted 1 if score >= 0.5): a field fitted on labelled documents that aren't held out, applied to all."""
    own = docs.select(F.col(id_col), F.col(text_col))
    field = fit(own, labels, id_col, text_col)
    rated = classify(own, field, text_col)
    return rated.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
