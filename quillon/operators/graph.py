"""Connected components of a graph given as edges, by label propagation with pointer jumping.

No vertex list, component or label set reaches the driver; only the number of changes per round does. A hub with
very many edges is pre-aggregated before each shuffle (minimum of its neighbours' labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import release, settle_table

MOST_ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the component is the least vertex in it. Self loops keep a lone vertex; null ends are
    ignored; parallel edges change nothing."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    # Both directions come from each row: in a union of the two the whole plan of the edges would stand twice, and run twice.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = settle_table(pairs.select(ways).select("way.*").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.col("vertex")).alias("component"))
    table = labels = settle_table(labels, "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("vertex").alias("b"), "component"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "vertex").select("vertex", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("next"))
        new = spread.join(jump, "component").select("vertex", F.least("component", "next").alias("component"), "old")
        new = settle_table(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        release(table)
        table, labels = new, new.drop("old")
        if not changed:
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
