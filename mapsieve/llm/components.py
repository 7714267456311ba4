"""Connected components of an edge table by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mapsieve.llm.common import split_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that is reached.  edges (a long, b long); loops and repeats are allowed.

    Each round points the larger neighbours of every node at the smallest (large star), then the
    smaller ones (small star).  A node with many edges is met as rows of a grouped minimum and of
    a join that splits hot nodes (split_join), never as a collected list.  Rounds end when a round
    leaves the edges as they were, about log(diameter) of them; each is written to the shared folder.

    Defined results: an edge with a null end is left out; a node that stands in loops alone has no
    row; an empty table gives no rows; extra columns are ignored.
    """
    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = split_join(both, low, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, ["a"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        # the check sums are taken while the edges are written
        seen = Observation()
        pairs = stored(small.observe(seen, F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("y")))
        now = seen.get
        if now == state:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
