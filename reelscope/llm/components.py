"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay in Spark. Each step takes the minimum over a node's neighbours with a grouped aggregate (partial sums before
the shuffle) and joins it back many-to-one, so a node with very many links is no bottleneck; each round is written to the
shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.shared import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); a component is named by its smallest node.

    Links may repeat, lie in either direction or join a node to itself; rows with a null end are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = written(edges.where("u > v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").distinct()
        # small star: link a node and its smaller neighbours to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        joined = edges.join(low, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).where("u > v").distinct()
        edges = written(edges, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return written(named.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component")), "components")
