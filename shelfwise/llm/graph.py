"""Connected components by randomised contraction, as DataFrame joins.

Each round every vertex moves to the neighbour (or itself) of least hash, edges are
renamed and deduplicated, and the vertex -> root map is composed with the move.  A
fresh hash each round shrinks the graph by a constant factor in expectation, so the
number of rounds is logarithmic in the longest chain.  A hub is reduced map-side
(``min`` aggregate); renaming joins meet a table with one row per vertex, so AQE can
split a hub's edges.  Nothing is collected but the count of edges left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long, either direction).

    ``root`` is an arbitrary but single node of the component.  Self-loops and repeats
    are harmless; an edge with a null end is ignored; no edges give no rows.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
               .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    roots = None
    turn = 0
    while e.limit(1).count():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("to"))
        half = e.select(F.col("a").alias("node"), order(F.col("b")).alias("m")).union(
            e.select(F.col("b").alias("node"), order(F.col("a")).alias("m")))
        near = half.groupBy("node").agg(F.min(F.col("m.h")).alias("h"), F.min("m").alias("m"))
        own = order(F.col("node"))
        move = stored(near.select("node", F.least(F.col("m"), own)["to"].alias("to")), "move")
        e = stored(
            e.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if roots is None:
            roots = move.select("node", F.col("to").alias("root"))
        else:
            nxt = move.select(F.col("node").alias("root"), "to")
            roots = roots.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots, "roots")
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
