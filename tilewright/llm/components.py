"""Connected components of a link table, as DataFrame operations that no hot node can gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.scratch import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent"))).first())


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the smallest node it can reach.

    Edges lead from a node to a smaller one. A round hangs a node's other parents below its smallest, then replaces each
    parent by that parent's own smallest. Depth halves, and the rounds end when nothing moves. Nodes are grouped only as
    children, which have few parents; a root with any number of children meets the join from two written tables, where
    Spark splits its rows. An empty table gives no rows; null ends of links are ignored.
    """
    met = links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    edges = materialize(met.distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = _state(edges)
        if now == before or now[0] == 0:
            break
        before = now
        least = F.min("parent").over(Window.partitionBy("child"))
        hung = edges.withColumn("least", least).select(
            F.explode(
                F.when(
                    F.col("parent") == F.col("least"), F.array(F.struct(F.col("child").alias("c"), F.col("least").alias("p")))
                ).otherwise(F.array(F.struct(F.col("parent").alias("c"), F.col("least").alias("p"))))
            ).alias("e")
        )
        hung = materialize(hung.select(F.col("e.c").alias("child"), F.col("e.p").alias("parent")).distinct(), "links")
        above = materialize(hung.groupBy("child").agg(F.min("parent").alias("up")), "links").withColumnRenamed("child", "of")
        jumped = hung.join(above, hung["parent"] == above["of"], "left")
        edges = materialize(
            jumped.select("child", F.coalesce("up", "parent").alias("parent")).distinct(), "links"
        )
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
        edges.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    )
