"""Connected components of a graph given as a table of edges, without collecting it anywhere.

Alternating stars: the large step hangs every larger neighbour of a node on the
least node it knows, the small step does the same with the smaller ones. The
number of rounds grows with the logarithm of the longest path. The least
neighbour of each node is aggregated before the shuffle and kept, so that the
join that follows is a plain one of two shuffled sides and a node with very many
neighbours can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node, root`` for every node of an edge between two different nodes; ``root`` is the least node that can be reached.

    Edges with a null end and loops join nothing; repeated edges count once; no
    edges give no rows.
    """
    a, b = F.col(u), F.col(v)
    now = saved(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("to")).union(now.select("lo", "hi"))
        least = saved(both.groupBy("n").agg(F.min("to").alias("m")).select("n", F.least("n", "m").alias("m")))
        large = saved(both.where("to > n").join(least, "n").select(F.col("to").alias("hi"), F.col("m").alias("lo")).distinct())
        least = saved(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = saved(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(now.select("lo", "lo").distinct())
