"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers, x to floor(256 * x). An index table holds each row's
codes, one byte per `SUB` components, and the norm of what its codebook vectors
leave, its residual. Codebooks are fitted by k-means on the `SAMPLE` rows of
least hashed id, a bound that doesn't depend on the table; the index holds all
rows.

For an anchor, look-up tables of its products with the codebook vectors give a
row's score but for the product of anchor and residual, which is at most the
product of their norms: score and bound are exact limits on the true score.
First each anchor's nearest rows of its label are found, its positives, then
for each positive the best rows of other labels whose score lies in its window.
A row is left out only where its limits show that it can't be among the results;
all others are scored again in whole numbers, and only these scores count.

Anchors are a stated set and meet all rows in blocks: a task holds one chunk of
rows and one block of anchors, whatever the table's size or its labels' shares.
Chunks go by a hash of the id, so neither a label nor a group of copies is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, stored

#: Components per code, codes per codebook, rows that codebooks are fitted on, and rounds of k-means.
SUB, CODES, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Rows of a chunk and anchors of a block; anchors are scored in slices of ANCHORS. A chunk meets a block in one of TASKS partitions at most.
CHUNK_ROWS, BLOCK_ROWS, ANCHORS, TASKS = 8192, 4096, 128, 10_000
#: Positives of an anchor, negatives of a pair, and the window in percent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
INDEX = "vec_id long, label long, v binary, codes binary, residual double"


@dataclass(frozen=True)
class Codebooks:
    """books: an array (part, code, component)."""

    books: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray) -> Codebooks:
        rng, n = np.random.default_rng(11), len(rows)
        parts = rows.reshape(n, -1, SUB)
        books = parts[rng.choice(n, CODES, replace=n < CODES)].transpose(1, 0, 2).copy()
        for m in range(parts.shape[1]):
            for _ in range(ROUNDS):
                own = nearest(parts[:, m], books[m])
                size = np.bincount(own, minlength=CODES)
                for k in range(SUB):
                    total = np.bincount(own, parts[:, m, k], CODES)
                    books[m, :, k] = np.where(size > 0, total / np.maximum(size, 1), books[m, :, k])
        return Codebooks(books)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms of rows."""
        parts = rows.reshape(len(rows), -1, SUB)
        codes = np.empty(parts.shape[:2], np.uint8)
        rest = np.zeros(len(rows))
        for m, book in enumerate(self.books):
            codes[:, m] = nearest(parts[:, m], book)
            rest += ((parts[:, m] - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(rest)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Products of anchors with codebook vectors: (part, code, anchor)."""
        return np.einsum("mck,amk->mca", self.books, anchors.reshape(len(anchors), -1, SUB))


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.intp)
    for lo in range(0, len(points), 4096):
        p = points[lo : lo + 4096]
        out[lo : lo + 4096] = ((book**2).sum(axis=1) - 2 * p @ book.T).argmin(axis=1)
    return out


def scores(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Look-up table scores (row, anchor)."""
    out = np.zeros((len(codes), tables.shape[2]))
    for m in range(len(tables)):
        out += tables[m].take(codes[:, m], axis=0)
    return out


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or less than any if there are fewer."""
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


def best(ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -own))[:k]


def integers(embedding: Column, dim: int) -> Column:
    """floor(256 * x) of each component, zeros after them up to dim."""
    v = F.transform(embedding, lambda x: F.floor(x * 256.0).cast("long"))
    return F.when(F.size(v) < dim, F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v)))).otherwise(v)


def index(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """The stored index, INDEX, of rows (id, label, vector) that take part, and its codebooks; None if there are no rows."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = own.where("vec_id is not null and label is not null and x is not null").where(~F.exists("x", odd))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    dim, n = own.agg(F.max(F.size("x")), F.count("*")).first()
    dim = -(-max(1, dim or 1) // SUB) * SUB
    own = own.select("vec_id", "label", integers(F.col("x"), dim).alias("v"))
    sample = own.select("v", F.xxhash64("vec_id").alias("h")).where(sampled("h", 2 * SAMPLE, n)).orderBy("h").limit(SAMPLE).select("v").toPandas()["v"]
    books = Codebooks.fit(np.stack(sample.to_numpy()).astype(float)) if len(sample) else None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                codes, rest = books.encode(v.astype(float))
                packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(v), packed(codes), pa.array(rest)], ["vec_id", "label", "v", "codes", "residual"])

    return stored(own.mapInArrow(encode, INDEX)), books


def positives(ids: np.ndarray, labels: np.ndarray, own: Block, books: Codebooks, anchors: Block, k: int) -> list[dict[str, np.ndarray]]:
    """For each anchor the chunk's k best rows of its label, other than itself."""
    out = []
    for label in np.unique(anchors.labels):
        same = np.flatnonzero(labels == label)
        asked = np.flatnonzero(anchors.labels == label)
        for part, near, far in limits(own, same, books, anchors, asked):
            for j, a in enumerate(part):
                other = ids[same] != anchors.ids[a]
                some = same[(far[:, j] >= kth(near[other, j], k)) & other]
                exact = own.v[some] @ anchors.v[a]
                top = best(ids[some], exact, k)
                out.append({"anchor_id": np.full(len(top), anchors.ids[a]), "other_id": ids[some[top]], "score": exact[top]})
    return out


def negatives(ids: np.ndarray, labels: np.ndarray, own: Block, books: Codebooks, anchors: Block, k: int, low: int, high: int) -> list[dict[str, np.ndarray]]:
    """For each positive of an anchor the chunk's k best rows of other labels in its window."""
    out = []
    for part, near, far in limits(own, np.arange(len(ids)), books, anchors, np.arange(len(anchors.ids))):
        for j, a in enumerate(part):
            other = labels != anchors.labels[a]
            least, most = near[:, j], far[:, j]
            for positive, score in anchors.positives[a]:
                floor, top = low * score, high * score
                sure = other & (100 * least >= floor) & (100 * most <= top)
                some = np.flatnonzero(other & (100 * most >= floor) & (100 * least <= top) & (most >= kth(least[sure], k)))
                exact = own.v[some] @ anchors.v[a]
                inside = (100 * exact >= floor) & (100 * exact <= top)
                some, exact = some[inside], exact[inside]
                first = best(ids[some], exact, k)
                out.append({"anchor_id": np.full(len(first), anchors.ids[a]), "positive_id": np.full(len(first), positive), "positive_score": np.full(len(first), score), "other_id": ids[some[first]], "score": exact[first]})
    return out


@dataclass(frozen=True)
class Block:
    """Rows of a task as arrays; positives, of anchors, are lists of (id, score)."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    codes: np.ndarray | None = None
    residual: np.ndarray | None = None
    positives: list | None = None

    @staticmethod
    def of(df: pd.DataFrame) -> Block:
        arrays = lambda c, kind: np.frombuffer(b"".join(df[c]), kind).reshape(len(df), -1)
        more = (arrays("codes", np.uint8), df["residual"].to_numpy()) if "codes" in df else (None, None)
        near = [[(p["id"], p["score"]) for p in x] for x in df["positives"]] if "positives" in df else None
        return Block(df["vec_id"].to_numpy(), df["label"].to_numpy(), arrays("v", np.int64), *more, near)


def limits(own: Block, rows: np.ndarray, books: Codebooks, anchors: Block, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the asked anchors with the least and the greatest score that each of the rows can have with them."""
    for lo in range(0, len(asked), ANCHORS):
        part = asked[lo : lo + ANCHORS]
        v = anchors.v[part].astype(float)
        got = scores(own.codes[rows], books.tables(v))
        # rounding in the sums is far below a millionth of the norms' product
        norm = np.sqrt((v**2).sum(axis=1))
        size = np.sqrt((own.v[rows].astype(float) ** 2).sum(axis=1))
        room = np.outer(own.residual[rows], norm) + 1e-9 * np.outer(size, norm) + 1e-6
        yield part, got - room, got + room


def search(table: DataFrame, anchors: DataFrame, task, columns: str) -> DataFrame:
    """What task(chunk, block) finds for each chunk of the index and each block of anchors."""
    chunks, blocks = max(1, -(-table.count() // CHUNK_ROWS)), max(1, -(-anchors.count() // BLOCK_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    tasks = min(chunks * blocks, TASKS)  # stated, so that small tables aren't put into one task
    left = table.select("*", dealt(chunks).alias("chunk"), every(blocks).alias("block")).repartition(tasks, "chunk", "block")
    right = anchors.select("*", dealt(blocks).alias("block"), every(chunks).alias("chunk")).repartition(tasks, "chunk", "block")
    names = [c.split()[0] for c in columns.split(", ")]

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = task(Block.of(left), Block.of(right)) if len(left) and len(right) else []
        return pd.DataFrame({c: np.concatenate([x[c] for x in found]) if found else [] for c in names})

    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(look, columns)


def first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows of the k best scores of each key, ties to the smaller other_id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    is_anchor is a condition on id_col. Scores are integer products of the
    vectors' whole numbers, which must fit into 64 bits. An anchor's positives
    are its n_positives best other rows of its label; each positive's negatives
    are the n_negatives best rows of other labels whose score is low to high
    percent of the positive's. Ties go to the smaller id. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part;
    shorter vectors count as if zeros followed; rows that repeat an id count
    once, with the least of its labels and vectors. No rows give none. Other
    columns of rows don't matter.
    """
    table, books = index(rows, id_col, label_col, vector_col)
    if books is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = table.select(F.col("vec_id").alias(id_col), "label", "v") if id_col != "vec_id" else table.select("vec_id", "label", "v")
    anchors = named.where(is_anchor).withColumnRenamed(id_col, "vec_id")
    near = search(table, anchors, lambda own, asked: positives(own.ids, own.labels, own, books, asked, n_positives), "anchor_id long, other_id long, score long")
    pairs = first(near, ["anchor_id"], n_positives).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("positives"))
    asked = stored(anchors.join(pairs, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    found = search(table, asked, lambda own, asked: negatives(own.ids, own.labels, own, books, asked, n_negatives, low, high), "anchor_id long, positive_id long, positive_score long, other_id long, score long")
    return first(found, ["anchor_id", "positive_id"], n_negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
