"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star steps: each points neighbours at the smallest node around, so
    the links of a round are at most those of the round before plus one for each node. A round is
    written to the shared folder. Null ends and loops are ignored; repeated links count once.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    links = materialize(links, "links")
    mark = None
    for _ in range(most_rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
