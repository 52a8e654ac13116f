"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._store import discard, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with the smallest node it is connected to.

    Alternating large and small stars: each node's neighbours are linked to the smallest of them, those
    above the node first and then those below.  The edge list never grows, each round is a few exchanges
    with map-side minima, and every round's edges are written to the shared folder in place of the last round's.  It ends when a
    round leaves the edges as they were, which takes about the logarithm of the longest path.  Loops and
    repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = stage(pairs.distinct(), "edges")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, pairs = pairs, stage(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
