"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its `K`-word windows (lower-cased words between white
space), each labelled with how often it came before; texts of fewer words are
one window, texts without a word have none. The similarity of two texts is
m / (a + b - m): a and b windows, m of them aligned in the same order. A sketch
takes the L labelled windows of least hash and keeps their text order, so two
texts that share it agree in content and order; SKETCHES of them find a pair at
0.8 with a probability over 0.9999.

Equal texts are one row from the start, known by a 64-bit hash: two of n
different texts share one with a chance of n * n / 3.7e19. Texts of a sketch's
bucket are compared until no bucket holds an uncompared pair of different
components. Comparing aligns the window sequences within the
diagonal band that a similarity of 0.8 leaves, exactly: labelled windows are
distinct, so the longest common subsequence is a longest increasing one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Likeness, bucket_components, connected_components, id_text, only, private, shared_keys, slices, stored
from .token_files import mix

K, L, SKETCHES, THRESHOLD = 5, 4, 20, 0.8
#: Texts whose sketches a task remembers to have given; the store is emptied beyond it, which bounds memory.
SEEN = 500_000


def windows(text: str, k: int = K) -> np.ndarray:
    """The text's k-word windows in order, as distinct 64-bit hashes of their words and occurrence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known: dict[str, int] = {}
    hashed = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], np.uint64)
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        h = mix(h ^ hashed[j : j + n], j)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    if new.all():
        return h
    place = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(occurrence > 0, mix(h ^ mix(occurrence, 8), 9), h)


def sketches(x: np.ndarray, size: int = L, count: int = SKETCHES) -> np.ndarray:
    """Order MinHash: a key for each sketch, of the `size` least windows in text order."""
    out = np.empty(count, np.uint64)
    step = max(1, 1_000_000 // max(1, len(x)))  # bounds the memory for very long texts
    for lo in range(0, count, step):
        seeds = mix(np.arange(lo, min(count, lo + step), dtype=np.uint64), 11)
        hashed = mix(x[None, :] ^ seeds[:, None], 12)
        least = np.argpartition(hashed, size - 1, axis=1)[:, :size] if len(x) > size else np.tile(np.arange(len(x)), (len(seeds), 1))
        key = seeds.copy()
        for column in x[np.sort(least, axis=1)].T:
            key = mix(key ^ column, 13)
        out[lo : lo + len(seeds)] = key
    return out


def aligned(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two window sequences; a value under the threshold where it is under it."""
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    least = threshold * (len(x) + len(y)) / (1 + threshold)  # of aligned windows
    if min(len(x), len(y)) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    inside = np.abs(i - j) <= len(x) + len(y) - 2 * least + 1  # every unaligned window shifts the diagonal by one
    j = j[inside]
    m = len(j)
    if m >= least - 1e-9 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for v in j.tolist():
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        m = len(tails)
    return m / (len(x) + len(y) - m)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the class's least doc_id), class_size (its rows).

    Classes are connected by equal texts and by similarities of the threshold
    and more. Null texts count as empty, and empty texts as equal. Rows with a
    null id are left out; repeated ids give a row each, all in their least
    class if their texts differ. Long texts are compared whole. No rows give
    none; other columns are left out.
    """
    known = hashed(docs, id_col, text_col)
    sketched = sketch_table(known)
    texts = texts_of(sketched)
    tied = linked(known, sketched, texts, threshold)
    owned = sketched.select("doc_id", "h")
    # the same id under several texts ties these together, too
    several = stored(owned.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z"))
    if not several.isEmpty():
        ties = owned.join(several, "doc_id").where("h <> a").select("a", F.col("h").alias("b")).distinct()
        tied = connected_components(ties.unionByName(tied.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # classes by texts, for a text may have very many rows
    named = texts.join(tied.withColumnRenamed("node", "h"), "h", "left").where("component is not null or n > 1")
    several = stored(named.select("h", "first", "n", F.coalesce("component", "h").alias("c")))
    whole = stored(several.groupBy("c").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")))
    classes = several.join(whole, "c").select("h", "class_id", "class_size")
    return owned.join(classes, "h", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h): the rows that have an id, and their texts' hashes."""
    return id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("h", F.xxhash64("text"))


def texts_of(sketched: DataFrame) -> DataFrame:
    """(h, first, n): each text's least doc_id and number of rows; partial ones come before the shuffle."""
    return stored(sketched.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))


def sketch_table(known: DataFrame) -> DataFrame:
    """(doc_id, h, size, keys) of the rows: number of windows, and the sketches where a task meets a text first."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            if len(seen) > SEEN:
                seen.clear()
            size, keys = [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                new = h not in seen
                seen.add(h)
                x = windows(text) if new else ()
                size.append(len(x))
                keys.append(sketches(x).view(np.int64) if len(x) else None)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "size", "keys"])

    return stored(known.mapInArrow(sketch, "doc_id long, h long, size long, keys array<long>"))


def linked(known: DataFrame, sketched: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the texts, by their hashes, that verified links join."""

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [windows(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(x, pa.binary())], names=["id", "value"])

    buckets = shared_keys(sketched.where("keys is not null").select(F.explode("keys").alias("key"), F.col("h").alias("id"), "size"))
    nodes = buckets.select(F.col("id").alias("h")).distinct()
    first = stored(texts.select("h", F.col("first").alias("doc_id")).join(nodes, "h", "left_semi"))
    one = only(known, first, ["doc_id", "h"]).select("h", "text")
    # rows that repeat an id and a text give it again
    items = stored(one.mapInArrow(vector, "id long, value binary").groupBy("id").agg(F.first("value").alias("value")))
    vector_of = lambda x: np.frombuffer(x, np.uint64)
    # aligned windows are common ones, so texts whose common windows are too few aren't alike
    likeness = Likeness(vector_of, lambda x, y: aligned(x, y, threshold) >= threshold, lambda values: [vector_of(x) for x in values], threshold)
    return bucket_components(buckets, items, likeness)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of texts, that of the least id (of its texts, the one of least hash).

    Rows with a null id stay. Rows that repeat an id are told apart by their
    texts: those of one class stay once, those of several once for each. Null
    texts count as empty, long ones are compared whole; no rows give none.
    """
    known = hashed(docs, id_col, text_col)
    sketched = sketch_table(known)
    texts = texts_of(sketched)
    named = linked(known, sketched, texts, THRESHOLD).withColumnRenamed("node", "h")
    classes = texts.join(named, "h", "left").where("component is not null or n > 1")
    several = stored(classes.select("h", "first", F.coalesce("component", "h").alias("c")))
    firsts = stored(several.groupBy("c").agg(F.min(F.struct(F.col("first").alias("doc_id"), "h")).alias("kept")))
    kept = several.join(firsts, "c").select("h", "kept")
    doc, of, own, n = private(docs, "doc", "of", "own", "n")
    row = F.struct("doc_id", "h")
    dropped = sketched.select("doc_id", "h").join(kept, "h").where(row != F.col("kept")).select(F.col("doc_id").alias(doc), F.col("h").alias(of)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = (F.col(own) == F.col(of)) & (F.col(id_col).cast("long") == F.col(doc))
    left = rows.join(dropped, same, "left_anti")
    again = stored(sketched.groupBy(F.col("doc_id").alias(doc), F.col("h").alias(of)).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n))
    if not again.isEmpty():
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return left.drop(own)
