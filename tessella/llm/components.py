"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import forget, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest id reachable over the edges, for every id that has one.

    Alternates large-star and small-star steps. Both use a minimum per vertex
    and a join, never a list of neighbours, so a vertex of any degree is safe.
    No edges: an empty table. Self-loops and repeated edges are ignored.
    """
    e = edges.select(F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi")).where("lo < hi").distinct()
    e = stored(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("v")).agg(F.least(F.min("hi"), F.first("lo")).alias("m"))
        # large star: each larger neighbour of v is linked to v's smallest neighbour
        large = e.join(least, e.lo == least.v).select(F.col("m").alias("lo"), "hi").where("lo < hi")
        # small star: each vertex links its smaller neighbours to the smallest of them
        large = stored(large.distinct(), "large")
        own = large.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        small = large.join(own, large.hi == own.v).select("m", "lo", "hi")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))).alias("e"))
        nxt = stored(small.select("e.lo", "e.hi").where("lo < hi").distinct(), "edges")
        forget(large)
        forget(e)
        e = nxt
        now = tuple(e.agg(F.count("*"), F.count_distinct("hi"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component_id"))).distinct()
        before = now
