"""Connected components by alternating large-star and small-star steps.

Each step is two joins and aggregations on the edge table, so no node's neighbours meet in one row or on the
driver; minima are pre-aggregated before the shuffle and skewed joins are left to adaptive execution, which
may split them. Every round is written to the shared folder, so lost executors cost one round at most.

Defined cases: an edge with a null end, or from a node to itself, says nothing; repeated edges count once; without any
edge the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, new_folder


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From (a, b), both long: (node, root) for every node with an edge; root is its component's least node."""
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    data, path = write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds):
        # Large-star: a node's larger neighbours go to its least one. A node without a smaller neighbour is its own
        # least, so only the others are looked up, and the edges of a hot centre may be split over tasks.
        lower = data.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
        large = data.join(lower, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b"))
        )
        fresh, fresh_path = write(small.distinct())
        drop_folder(spark, path)
        data, path = fresh, fresh_path
        # Done when every node hangs on one root and no root hangs on another node.
        pairs = data.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
        if pairs <= 1 and not data.join(data.select(F.col("b").alias("a")), "a", "left_semi").take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return data.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        data.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
