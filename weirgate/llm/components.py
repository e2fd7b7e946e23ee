"""Connected components of a graph given as edges, by contraction rounds kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.shared import few, stage
from weirgate.materialize import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of a type with an order. Returns node, root for each node of an edge; the root is one node of the component.

    In each round a node takes the first of all nodes within two edges, in an order by hashes that is new each round;
    edges move to those labels and edges within a label go. A hub and its leaves are one label after a round, and of a long path
    at least half of the labels go, so rounds grow with the logarithm of the nodes. Minima combine before the shuffle, so a hub's edges never
    meet in one task; joins on a hub are left to the skew handling of adaptive execution. A round's tables are in as many
    files as their rows ask for, and go at the end.
    """
    with scratch(edges.sparkSession):
        return _contracted(edges)


def _contracted(edges: DataFrame) -> DataFrame:
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    nodes = roots.count()
    turn = 0
    while n := edges.count():
        turn += 1
        ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = stage(few(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("b"), F.least(ranked("a"), "m")["n"].alias("near")), n), "near")
        # A node is among the neighbours of each of its own.
        label = stage(few(both.join(near, "b").groupBy(F.col("a").alias("n")).agg(F.min(ranked("near"))["n"].alias("label")), n), "labels")
        to_a, to_b = (label.select(F.col("n").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("la <> lb")
        edges = stage(few(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), n), "edges")
        roots = stage(few(roots.join(label.withColumnRenamed("n", "root"), "root", "left").select("node", F.coalesce("label", "root").alias("root")), nodes), "roots")
    return written(roots, "roots", outer=True)
