"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, noted, stored


def components(edges: DataFrame, first: str, second: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two columns of one type that has an order); ``root`` is the least node reachable.

    Edges with a null end and edges from a node to itself link nothing. Each round is written to the
    shared folder, so a lost executor costs one round, and goes once the next one is written. A node
    with many neighbours is met only in joins and minima, never gathered into a list.
    """
    spark = edges.sparkSession
    with noted() as held:
        at = stored(edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u <> v").distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        ends = at.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))))
        least = ends.groupBy("node").agg(F.min("other").alias("m"))
        with noted() as made:
            large = stored(at.join(least, at.v == least.node).select("u", F.least("v", "m").alias("v")), "components-large")
            own = large.groupBy("u").agg(F.min("v").alias("m"))
            # the row that holds the least one of u keeps it, the others pass it on
            small = large.join(own, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            at = stored(small.distinct(), "components")
        discard(spark, [*held, made[0]])
        held = made[1:]
        mark = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
        seen = mark
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
