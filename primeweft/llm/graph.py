"""Connected components by hooking and pointer jumping.

Edges lead from a vertex to a smaller one.  In a round each vertex keeps its smallest
neighbour, hooks its others to that one, and every edge jumps to its end's smallest
neighbour.  A round that changes nothing ends it, after a number of rounds
logarithmic in the size for practical graphs.  No neighbourhood is gathered in a
task: minima come by partial aggregation, and joins may split a vertex with many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(a, root) of each vertex of the edges (a, b) that isn't a root; a root is the smallest of its component.

    Vertices are of any type that can be ordered.
    """
    now, path = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        own = now.join(least, "a")
        hooked = F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("x"), F.col("m").alias("y"), F.lit(True).alias("moved")))
        kept = F.struct(F.col("a").alias("x"), F.col("m").alias("y"), F.lit(False).alias("moved"))
        pairs = own.select(F.explode(F.array(kept, hooked)).alias("e")).where("e is not null").select("e.x", "e.y", "e.moved")
        jumped = pairs.join(least.select(F.col("a").alias("y"), F.col("m").alias("z")), "y", "left")
        after = jumped.select(F.col("x").alias("a"), F.coalesce("z", "y").alias("b"), (F.col("moved") | F.col("z").isNotNull()).alias("moved"))
        old = path
        now, path = written(after.groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        discard(edges.sparkSession, [old])
        if not now.agg(F.max("moved")).first()[0]:
            return now.select("a", F.col("b").alias("root"))
        now = now.select("a", "b")
