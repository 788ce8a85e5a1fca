"""Nearest neighbours by a hash-prefix forest.

Rows are dealt into chunks of about `chunk_rows`. A chunk's forest has `trees`
sorted arrays of `BITS`-bit hash strings, each bit the side of a random
hyperplane; inner products become angles by one more coordinate, the root of
the greatest squared norm less the row's own. A query descends each tree to its
longest matching prefix; then all trees ascend together, a bit at a time, until
the rows under the prefixes are `share` of the chunk, counted once per tree.
Those rows' inner products are computed in double precision, and the best k of
all chunks are the answer.

The queries are a stated set and meet the chunks in blocks of `query_rows`, so
a task holds a chunk and a block whatever the table's size. Equal vectors are
rows like others: a chunk holds its share of them and no more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS, TREES, SHARE, SEED = 32, 48, 1.0, 7
CHUNK_ROWS, QUERY_ROWS = 8192, 2048
FOUND = "query_id long, vec_id long, score double"


def planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * BITS))


def hashes(points: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as integers, the first bit the highest: a row per tree."""
    side = (points @ planes(points.shape[1], trees) > 0).reshape(len(points), trees, BITS)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return (side * weights).sum(axis=2, dtype=np.uint64).T


class Forest:
    def __init__(self, vectors: np.ndarray, greatest: float, trees: int):
        """greatest: the largest squared norm of all rows."""
        self.vectors = vectors
        extra = np.sqrt(np.maximum(greatest - (vectors**2).sum(axis=1), 0))
        codes = hashes(np.c_[vectors, extra], trees)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """For each query the rows under its prefixes, all trees being at the longest length at which these are `least` in all."""
        trees, n = self.codes.shape
        codes = hashes(np.c_[queries, np.zeros(len(queries))], trees)
        low = np.empty((BITS + 1, trees, len(queries)), np.int32)
        high = np.empty_like(low)
        for length in range(BITS + 1):
            shift = np.uint64(BITS - length)
            for t in range(trees):
                first = (codes[t] >> shift) << shift
                low[length, t] = np.searchsorted(self.codes[t], first, side="left")
                high[length, t] = np.searchsorted(self.codes[t], first + (np.uint64(1) << shift) - np.uint64(1), side="right")
        under = (high - low).sum(axis=1)
        # counts fall with the length; the root has all rows of every tree
        length = np.maximum((under >= min(least, trees * n)).sum(axis=0) - 1, 0)
        out = []
        for q in range(len(queries)):
            own = np.zeros(n, bool)
            for t in range(trees):
                own[self.order[t, low[length[q], t, q] : high[length[q], t, q]]] = True
            out.append(np.flatnonzero(own))
        return out


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null nor zero, all components finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd) & F.exists(embedding, lambda x: x != 0)


def search(rows: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, share: float = SHARE, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k rows of largest inner product found, ties to the smaller id.

    is_query is a condition on columns of rows. Invalid vectors and rows with a
    null id take no part; shorter vectors count as if zeros followed. A query
    meets every row but those of its own id; rows that repeat an id count once,
    with the least of its vectors, and as a query if one of them is. Ties go to
    the smaller id. No rows give none.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    own = own.where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    own = own.groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("is_query").alias("is_query"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = own.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.max(squares).alias("greatest")).first()
    dim, n, greatest = size["dim"] or 1, size["n"] or 1, size["greatest"] or 1.0
    own = own.withColumn("v", F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v")))
    queries = own.where("is_query")
    chunks, blocks = -(-n // chunk_rows), max(1, -(-queries.count() // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = own.select("vec_id", "v", dealt(chunks).alias("chunk"), every(blocks).alias("block"))
    right = queries.select("vec_id", "v", dealt(blocks).alias("block"), every(chunks).alias("chunk"))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, vectors = left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy())
        queries, query_ids = np.stack(right["v"].to_numpy()), right["vec_id"].to_numpy()
        forest, out = Forest(vectors, greatest, trees), []
        for lo in range(0, len(queries), 256):
            for q, found in enumerate(forest.candidates(queries[lo : lo + 256], share * len(ids)), lo):
                if len(found) <= k:
                    found = np.arange(len(ids))
                found = found[ids[found] != query_ids[q]]
                scores = vectors[found] @ queries[q]
                if len(found) > k:
                    found = found[scores >= np.partition(scores, -k)[-k] - 1e-9 * greatest]
                exact = (vectors[found] * queries[q]).sum(axis=1)  # the same for equal rows, wherever they stand
                best = np.lexsort((ids[found], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[found[best]], "score": exact[best]}))
        return pd.concat(out)

    found = cut(left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(look, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
