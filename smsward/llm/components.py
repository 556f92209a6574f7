"""Connected components of an edge table, by minimum labels, pointer jumping and contraction.

Each round every node takes the least of itself and its neighbours (a partial aggregate before its shuffle,
so a node of any degree is one row a task), then that label's own label; edges are then rewritten between
labels, and equal ones and loops go, so that a group of any size is a few edges after the first round.
Tables of a round are written to the shared folder and deleted when the next round's are there, and only whether edges remain reaches the driver.
A label that a large share of nodes points to is a frequent value of the joins on it, which Spark's skew handling splits.

Cases: loops, repeated edges and edges both ways count once or not at all; rows with a null end are ignored; an empty table gives an
empty one; a path of n nodes takes about log n rounds, and more than `most_rounds` are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.llm.common import written
from smsward.scratch import discard, mark


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs). Gives node, root for each node of an edge; root: one of the component's nodes."""
    spark, since = edges.sparkSession, mark()
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        ends = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), "a"))
        step = written(ends.groupBy("node").agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "step")
        next_up = step.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jump = written(step.join(next_up, "up").select("node", "root"), "jump")
        first = edges.join(jump.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = first.join(jump.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(both.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        own = jump.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = written(jump if labels is None else labels.join(own, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        discard(spark, since, keep=2)
        if not edges.limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
