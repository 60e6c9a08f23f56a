"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from fathomdoc.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours of each node below the smallest of them and the node: the larger ones, or the smaller ones.

    The minimum is aggregated before the shuffle, and only then joined to the edges, so a node with very many
    neighbours is no group of one task.
    """
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("u", "low").alias("low"))
    met = both.join(least, both.a == least.u)
    moved = met.filter("b > a" if large else "b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node in (a, b), with the smallest node of its component as label. Edges to oneself and
    edges with a null end are left out."""
    current = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        current = written(_star(_star(current, True), False), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
