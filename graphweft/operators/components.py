"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables


def _settled(parents: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of a forest (node, parent) in which roots are their own parents, by pointer jumping: rounds halve the depth."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = tables.write(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")))
        tables.drop(parents)
        if jumped.where("moved").isEmpty():
            return jumped.select("node", F.col("parent").alias("root"))
        parents = jumped.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: of one ordered type); root is the smallest node.

    Each node hooks to its smallest neighbour if that is smaller, the trees that make are
    flattened by pointer jumping, and the edges are contracted to their roots. A root that
    neither hooks nor is hooked to has a smaller neighbour after contraction, so the roots
    at least halve every two contractions, whatever the shape: rounds grow with the
    logarithm of the number of nodes (squared at the very worst), without a bound on either.
    Minima combine before they are shuffled and tables are dealt anew between rounds, so a
    node with very many neighbours costs no more than the others. All tables are written to
    the shared folder: neither nodes nor links ever go to the driver. Nulls and loops are
    ignored.
    """
    tables = Tables(edges.sparkSession)
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = tables.write(edges.where("a is not null and b is not null and a <> b").select(*ends("a", "b")).distinct())
    levels: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent"))
        stars = _settled(tables.write(hooked), tables)
        levels.append(stars)
        end = lambda x: stars.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        apart = links.join(end("a"), "a").join(end("b"), "b").where("root_a <> root_b").select(*ends("root_a", "root_b"))
        links = tables.write(apart.distinct())
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels.pop()
    while levels:  # from the few roots of the last level down to all nodes
        lower, above = levels.pop(), found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = tables.write(lower.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    return found
