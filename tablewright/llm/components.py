"""Connected components of a stored edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import materialize
from tablewright.sources.scratch import discard


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges: equal tables have equal states."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of `edges` (a BIGINT, b BIGINT); a component is its smallest node.

    Each round is written to the shared folder, so lineage stays short and nothing is held by the driver but
    a count and a checksum; tables of past rounds are deleted. A node's minimum is summed before the shuffle, and joins meet stored tables, so
    a node with very many edges is split. The rounds grow with the logarithm of the longest path.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(both.distinct(), "cc-edges", edges.count())
    state = _state(now)
    while state[0]:
        rows = 2 * state[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        was_now = now
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-large", rows)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "cc-large-star", rows)
        discard(least, was_now)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small", rows)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc-edges", rows)
        discard(large, least)
        was, state = state, _state(now)
        if was == state:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
