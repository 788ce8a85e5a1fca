"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, spread, stored


#: Edges beyond which a round's least neighbours are stored before they are joined, so that Spark can split a hub's rows.
MANY = 5_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50, many: int = MANY) -> DataFrame:
    """Union-find by joins: (node, component), component the least node of each.

    Alternates large-star and small-star rounds until every node is either a
    root or has one edge, to a root. Each round takes the least neighbour with
    a combining aggregate, never a list of neighbours; of many edges it is
    stored before it is joined, so a hub with a third of all edges is a plain
    skewed join that Spark splits. Shuffles have as many partitions as their
    edges need, so a task's memory doesn't grow with them. A round's edges are a table in the shared
    folder; all but the last are deleted. Nodes without an edge have no row.
    """
    spark = edges.sparkSession
    # counted first, so that a task's share of the distinct edges is bounded
    raw = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    n = raw.count()
    with spread(spark, n):
        e = stored(raw.distinct())
    discard(raw)
    for _ in range(max_rounds):
        # both directions of an edge are rows of a round
        with spread(spark, 2 * n):
            ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
            tangled, n = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1")), F.coalesce(F.sum("up"), F.lit(0))).first()
            if not tangled:
                break
            apart = stored if n > many else lambda df: df
            both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = apart(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            last, e = e, stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
            for done in (last, *((least, large) if n > many else ())):
                discard(done)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
