"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Rounds of hooking to the smallest neighbour and following pointers, each written to the shared folder.  A round
    is two aggregations with partial sums and equality joins, so a node with many edges costs no more than its edges
    spread over tasks; the number of rounds is logarithmic in the longest path.  Loops and repeated edges do no harm;
    nulls are not allowed; no edges give no rows.
    """
    pairs = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    live = pairs.where("a <> b")
    while not live.isEmpty():
        # every root hooks to the smallest root next to it
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
        hook = both.groupBy("e.x").agg(F.min("e.y").alias("y")).select("x", F.least("x", "y").alias("to"))
        hook = materialise(hook)
        jump = hook.join(hook.select(F.col("x").alias("to"), F.col("to").alias("further")), "to", "left")
        short = materialise(jump.select("x", F.coalesce("further", "to").alias("to")))
        follow = short.select(F.col("x").alias("root"), "to")
        roots = materialise(roots.join(follow, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        step_a = live.join(short.select(F.col("x").alias("a"), F.col("to").alias("a2")), "a")
        step_b = step_a.join(short.select(F.col("x").alias("b"), F.col("to").alias("b2")), "b")
        live = materialise(step_b.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return roots
