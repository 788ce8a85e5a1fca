"""Duplicate candidates among events.

An event has up to three keys: certain (uid and recurrence identity), likely
(title, start, end or duration, location), possible (title and start). Events
come in an order, and the first holder of a key owns it; a later event pairs
with the owner of its strongest key that has one, once. An event that pairs
doesn't register its weaker keys.

`candidates` does this exactly, a pass for each kind of key, strongest first:
what pairs by a key takes no part in the passes after it. `owner_pairs` is the
single window pass.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_event_text
from ..session import cut, stored

CONFIDENCE = ["certain", "likely", "possible"]


def seed_columns(uid: Column, identity: Column, title: Column, start: Column, end: Column, location: Column) -> dict[str, Column]:
    """The three keys, 128 bits of a digest each; the certain one is null without a uid."""
    key = lambda *c: F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", *(F.coalesce(x.cast("string"), F.lit("")) for x in c)), 256)), 1, 16)
    title, location = normalize_event_text(title), normalize_event_text(location)
    return {
        "certain": F.when(F.trim(F.coalesce(uid, F.lit(""))) != "", key(F.lit("c"), F.trim(uid), F.coalesce(identity, F.lit("master")))),
        "likely": key(F.lit("l"), title, start, end, location),
        "possible": key(F.lit("p"), title, start),
    }


def with_seeds(events: DataFrame) -> DataFrame:
    """(idx, uid, instance, rank, key) rows of events that have idx and the seeds' columns."""
    seeds = seed_columns(F.col("uid"), F.col("identity"), F.col("title"), F.col("start_key"), F.col("end_key"), F.col("location"))
    ranked = F.array(*(F.struct(F.lit(k).alias("rank"), seeds[c].alias("key")) for k, c in enumerate(CONFIDENCE)))
    return events.select("idx", F.trim(F.coalesce("uid", F.lit(""))).alias("uid"), F.coalesce("identity", F.lit("master")).alias("instance"), F.explode(ranked).alias("s")).select("idx", "uid", "instance", "s.rank", "s.key").where("key is not null")


def owner_pairs(seeds: DataFrame) -> DataFrame:
    """(idx, owner, rank): each event and the first holder of its strongest shared key."""
    first = Window.partitionBy("key").orderBy("idx")
    owned = seeds.withColumn("o", F.first(F.struct("idx", "uid", "instance")).over(first)).where("o.idx < idx")
    # one uid with different recurrence instances isn't a duplicate
    owned = owned.where(~((F.col("uid") != "") & (F.col("uid") == F.col("o.uid")) & (F.col("instance") != F.col("o.instance"))))
    best = owned.groupBy("idx").agg(F.min_by("o.idx", "rank").alias("owner"), F.min("rank").alias("rank"))
    return best.select("idx", "owner", "rank")


def candidates(events: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(idx, owner, confidence): duplicate candidates in the order of events.

    Of the events that no stronger key paired, the first holder of a key can't
    pair by it, so it registers it and owns it. That holds where an event has
    one key of a kind; ids that repeat may have more, and go by rounds.
    """
    seeds = cut(with_seeds(events))
    repeated = seeds.where(F.col("rank") == len(CONFIDENCE) - 1).groupBy("idx").count().where("count > 1")
    pairs = paired_by_rounds(seeds, max_rounds) if not repeated.isEmpty() else paired_by_rank(seeds)
    return pairs.select("idx", "owner", F.get(F.array(*map(F.lit, CONFIDENCE)), "rank").alias("confidence"))


def paired_by_rank(seeds: DataFrame) -> DataFrame:
    """(idx, owner, rank) of seeds whose ids don't repeat."""
    found, left = [], seeds
    for rank in range(len(CONFIDENCE)):
        own = left.where(F.col("rank") == rank)
        # stored, as it is read for owners and for their followers; pairs, as Spark leaves few of them out without a shuffle
        own = stored(own) if found else own
        found.append(stored(owner_pairs_among(own, own)))
        left = left.where(F.col("rank") > rank).join(found[-1].select("idx"), "idx", "left_anti")
    return functools.reduce(DataFrame.unionByName, found)


def paired_by_rounds(seeds: DataFrame, max_rounds: int) -> DataFrame:
    """(idx, owner, rank) of any seeds.

    Rounds alternate: pair with current owners, then take the weaker keys of
    paired events away; a round that changes nothing is the answer.
    """
    live, last = seeds, None
    for _ in range(max_rounds):
        pairs = cut(owner_pairs_among(seeds, live))
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("idx", "owner", "rank"))).first()
        if now == last:
            break
        last = now
        paired = pairs.select("idx", F.col("rank").alias("at"))
        live = seeds.join(paired, "idx", "left").where("at is null or rank < at").drop("at")
    return pairs


def owner_pairs_among(seeds: DataFrame, live: DataFrame) -> DataFrame:
    """owner_pairs with owners from the registered keys only."""
    owners = live.groupBy("key").agg(F.min(F.struct("idx", "uid", "instance")).alias("o"))
    owned = seeds.join(owners, "key").where("o.idx < idx")
    owned = owned.where(~((F.col("uid") != "") & (F.col("uid") == F.col("o.uid")) & (F.col("instance") != F.col("o.instance"))))
    best = owned.groupBy("idx").agg(F.min_by("o.idx", "rank").alias("owner"), F.min("rank").alias("rank"))
    return best.select("idx", "owner", "rank")


def exactness(a: Column, b: Column, fields: list[str]) -> Column:
    """Whether two event structs agree in all fields, nulls counting as empty."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.coalesce(a[f].cast("string"), F.lit("")) == F.coalesce(b[f].cast("string"), F.lit("")))
    return out
