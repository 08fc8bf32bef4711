"""Connected components of a large graph by random contraction.

In each round every node joins the neighbour (or itself) of least random
priority, edges are rewritten to the joined nodes, and self-loops and repeats
go.  The priorities change from round to round, so the expected number of
edges falls by a constant factor whatever the shape of the graph (a path
sorted by id included).  Rounds and maps are written tables; nothing but a
row count comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; bigint).  The root is
    one node of the component, the same for all its nodes."""
    live = materialize(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not live.isEmpty():
        turn = len(maps)

        def ranked(c, turn=turn):
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("v"))

        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(F.col("m"), ranked("a")).getField("v").alias("root"))
        joined = materialize(joined, "contract")
        maps.append(joined)
        left = joined.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = joined.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = live.join(left, "a").join(right, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = materialize(live, "edges")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole = maps[-1]
    for m in reversed(maps[:-1]):
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("later"))
        whole = m.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
        whole = materialize(whole, "components")
    return whole
