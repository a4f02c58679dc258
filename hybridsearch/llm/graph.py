"""Connected components of an edge table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds that even a path of 2^60 nodes does not need; a guard against a defect, not a limit on results.
MAX_ROUNDS = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the component's smallest node) for every node of ``edges(a, b)``, both bigint.

    Each round links every node's larger neighbours to its smallest one (large star), then every node's
    smaller neighbours and itself to the smallest (small star), until nothing changes.  Edges never
    multiply: each round keeps at most as many as it got.  Every round is a table in the shared folder, and so are the
    smallest neighbours, so that Spark can divide the links of a node that has very many among tasks.
    Null ends, loops and repeated edges are ignored; an empty table gives no rows.
    """
    links = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least-neighbours")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # u > v in every row of large
        large = materialize(large, "large-stars")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialize(small.where("u <> v").distinct(), "links")
        # stable once no node has two smaller neighbours and no root is below another node
        unsettled = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not unsettled and not new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            links = new
            break
        links = new
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
