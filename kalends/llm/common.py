"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, discard, shared_dir, stored, temporary

__all__ = ["Likeness", "bucket_components", "connected_components", "cut", "discard", "id_text", "only", "private", "sampled", "shared_dir", "shared_keys", "slices", "stored", "temporary"]

#: Arrow batches are handled in slices of about so many bytes of text, which
#: bounds a task's memory whatever the batch holds.
SLICE_BYTES = 6_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text, a row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = size.to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    # workers outlive their task, and would keep what its batches took beside the next stage's
    batch = None
    pa.default_memory_pool().release_unused()


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as columns doc_id and text; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Ids that a semi-join may broadcast: 8 bytes each, so some tens of MB at most.
BROADCAST_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose `on` is among ids, distinct rows, broadcast if they are counted to be few and by a shuffle otherwise."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def sampled(h: str, k: int, n: int) -> Column:
    """Whether a hash is among the least such that about k of n rows are, so that a sort's tasks have few to send."""
    return F.shiftrightunsigned(h, 11) < int(2**53 * min(1.0, k / max(1, n)))


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct rows (key, id, size) whose key has two ids or more, stored.

    keyed's rows are distinct within a task at least, so a key has a row per
    task and id. One shuffle by key serves the comparison and the distinct.
    """
    bucket = Window.partitionBy("key")
    ends = keyed.select("key", "id", "size", F.min("id").over(bucket).alias("lo"), F.max("id").over(bucket).alias("hi"))
    return stored(ends.where("lo <> hi").select("key", "id", "size").distinct())


#: Members of a group that is compared within a task, and the largest sum of their sizes.
MEMBERS, SIZE = 512, 4_000_000
#: Leaders of a larger bucket in the first round; they grow by GROWTH from round to round.
LEADERS, GROWTH = 256, 4


@dataclass(frozen=True)
class Likeness:
    """When two values are linked: alike(prepare(a), prepare(b)), which is only so if the Jaccard similarity of their
    features reaches the threshold; features(values) has an array of distinct 64-bit integers for each."""

    prepare: Callable[[Any], Any]
    alike: Callable[[Any, Any], bool]
    features: Callable[[list], list[np.ndarray]]
    threshold: float


def bucket_components(buckets: DataFrame, items: DataFrame, likeness: Likeness) -> DataFrame:
    """(node, component) as if all pairs of each bucket were compared.

    buckets: distinct rows (key, id, size) of keys with two ids and more; items:
    a row (id, value) of each id. Nodes without a link have no row.

    Buckets of the same members are one. The members of an ordinary bucket are
    compared in one task, but for those that links found there join already. A
    larger bucket is dealt into groups of that size, each with the bucket's
    first member besides: the one that shares most buckets with others (in a
    group of edited copies, the text they come from). What is left of larger
    buckets goes in rounds: leaders from outside the bucket's largest component
    go to each of its groups, are compared with the members of other components
    there, and are done; components follow. A bucket ends when it lies in one
    component, so no uncompared pair of different components is left.
    """
    members = buckets.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    groups = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("size") / SIZE)).cast("long")
    room = F.greatest(F.lit(1), F.floor(SIZE * F.col("n") / F.greatest("size", F.lit(1))))  # members of a mean size that SIZE holds
    kinds = members.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key"), F.min("size").alias("size"))
    kinds = stored(kinds.select("key", "n", groups.alias("groups"), room.cast("long").alias("room")))
    chosen = buckets.join(kinds, "key").select("key", "id", "n", "groups", "room")
    large = chosen.where("groups > 1")
    part = F.pmod(F.xxhash64("key", "id"), "groups").alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part")
    dealt = chosen.select("key", part, "id")
    several = not kinds.where("groups > 1").isEmpty()
    if several:
        weight = large.groupBy("id").agg(F.sum("n").alias("weight"))
        first = large.join(weight, "id").groupBy("key", "groups").agg(F.max_by("id", F.struct("weight", F.xxhash64("id"))).alias("id"))
        dealt = dealt.unionByName(first.select("key", every, "id")).distinct()

    def links(rows: DataFrame, anew: bool) -> DataFrame:
        """(a, b) of the components that rows (key, part, id, component, leads) show to be one; anew if a group's leaders haven't met elsewhere."""
        grouped = rows.join(items, "id").repartition("key", "part").sortWithinPartitions("key", "part")
        return grouped.select("key", "part", "component", "leads", "value").mapInArrow(_comparison(likeness, anew), "a long, b long")

    named = connected_components(links(dealt.select("key", "part", "id", F.col("id").alias("component"), F.lit(True).alias("leads")), True))
    own, last, leaders = large.select("key", "id", "groups", "room"), None, LEADERS
    while several:
        placed = own.join(named.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "groups", "room", F.coalesce("component", "id").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        state = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.min_by("least", F.struct("n", "component")).alias("one")).where("parts > 1")
        state = state.select("key", F.col("main.component").alias("main"), (F.col("n") - F.col("main.n")).alias("others"), "one")
        most = F.least(F.lit(leaders), "room")
        leads = (F.col("component") != F.col("main")) & ((F.col("others") <= most) | (F.pmod(F.xxhash64("key", "id"), "others") < most) | (F.col("id") == F.col("one")))
        now = stored(placed.join(state, "key").select("key", "id", "groups", "room", "component", leads.alias("leads")))
        if last is not None:
            discard(last)
        if now.isEmpty():
            break
        rows = now.where("not leads").select("key", part, "id", "component", "leads").unionByName(now.where("leads").select("key", every, "id", "component", "leads"))
        named = connected_components(links(rows, False).unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        own, last, leaders = now.where("not leads").select("key", "id", "groups", "room"), now, leaders * GROWTH
    return named


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Groups of more members are compared by their features first; of leaders, as many at a time as make so many bytes.
FEW, TABLE_BYTES = 16, 32_000_000


def _candidates(features: list[np.ndarray], leaders: list[int], threshold: float) -> list[list[int]]:
    """For each value the leaders whose features are similar enough, itself included: counts of common features by a table of leaders."""
    sizes = np.array([len(x) for x in features])
    known, at = np.unique(np.concatenate(features), return_inverse=True)
    own = np.split(at, sizes.cumsum()[:-1])
    out: list[list[int]] = [[] for _ in features]
    step = max(1, TABLE_BYTES // max(1, len(known)))
    for lo in range(0, len(leaders), step):
        some = np.array(leaders[lo : lo + step])
        table = np.zeros((len(known), len(some)), np.uint8)
        for column, k in enumerate(some.tolist()):
            table[own[k], column] = 1
        for k, x in enumerate(own):
            both = table[x].sum(axis=0, dtype=np.int32)
            out[k] += some[both >= (threshold - 1e-9) * (sizes[k] + sizes[some] - both)].tolist()
    return out


def _comparison(likeness: Likeness, anew: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares each group's leaders with all its members of other components; leaders among themselves if they are met anew, or in part 0."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = up
            return i

        def links(part: int, group: list) -> Iterator[dict[str, int]]:
            leaders, ready = [k for k, x in enumerate(group) if x[1]], [None] * len(group)
            near = None if len(group) <= FEW else _candidates(likeness.features([x[2] for x in group]), leaders, likeness.threshold)
            for k, (own, leads, _) in enumerate(group):
                for j in near[k] if near else leaders:
                    if leads and (j >= k or not (anew or part == 0)):
                        break
                    p, q = find(own), find(group[j][0])
                    if p == q:
                        continue
                    for x in (j, k):
                        if ready[x] is None:
                            ready[x] = likeness.prepare(group[x][2])
                    if likeness.alike(ready[j], ready[k]):
                        root[max(p, q)] = min(p, q)
                        yield {"a": max(p, q), "b": min(p, q)}
                if not leads:
                    ready[k] = None

        key, group = None, []
        for batch in slices(batches, "value"):
            found = []
            for *k, component, leads, value in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "part", "component", "leads", "value")), strict=True):
                if k != key:
                    found += links(key[1], group) if key else []
                    key, group = k, []
                group.append((component, leads, value))
            yield pa.RecordBatch.from_pylist(found, schema=PAIRS)
        yield pa.RecordBatch.from_pylist(list(links(key[1], group)) if key else [], schema=PAIRS)

    return compare
