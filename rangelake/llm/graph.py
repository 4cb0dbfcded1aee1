"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import cut


def _follow(pointers: DataFrame) -> DataFrame:
    """One pointer jump: v -> to -> to's own target."""
    step = pointers.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
    return pointers.join(step, F.col("to") == F.col("_v"), "left").select("v", F.coalesce("_to", "to").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node of its component.

    Each round points every node to its smallest neighbour, follows the pointers twice and contracts
    the edges along them, until none is left. Nodes of high degree meet pre-aggregated in the minimum,
    and in joins against one row per node. What a round makes is written and read again.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    out = None
    while True:
        both = edges.union(edges.select("b", "a"))
        pointers = both.groupBy("a", F.pmod("a", F.lit(2)).alias("_")).agg(F.min("b").alias("to")).select(F.col("a").alias("v"), F.least("a", "to").alias("to"))
        pointers = cut(_follow(_follow(cut(pointers))))
        if out is None:
            out = pointers.select(F.col("v").alias("node"), F.col("to").alias("comp"))
        else:
            out = cut(relabel(out, pointers.select(F.col("v").alias("node"), F.col("to").alias("comp"))))
        side = lambda c: pointers.select(F.col("v").alias(c), F.col("to").alias(f"t{c}"))
        edges = cut(edges.join(side("a"), "a").join(side("b"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct())
        if edges.isEmpty():
            return out


def relabel(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """labels (node, comp) with comp replaced where moved (node, comp) has it, and with the nodes that only moved has."""
    m = moved.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return labels.join(m, F.col("comp") == F.col("_node"), "left").select("node", F.coalesce("_comp", "comp").alias("comp"))
