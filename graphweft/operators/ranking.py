"""What is kept of a subgraph, in which order, and how it reads as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill

# Edges kept by the filter, by the scorer and in a text; nodes kept by position.
FILTER_EDGES, SCORED_EDGES, CONTEXT_EDGES, FIRST_NODES = 25, 20, 20, 10
# Hundredths an edge gets, for being there, for the intent's type or part of it, per shared word and at most for words, for a specific type, for a compound one.
BASE, TYPE, TYPE_PART, WORD, WORDS, LONG_TYPE, COMPOUND = 10, 40, 20, 15, 30, 10, 10


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type), the first by ``ord``."""
    return edges.groupBy("source_id", "target_id", "rel_type").agg(F.min("ord").alias("ord"))


def filter_edges(edges: DataFrame, relationship: str | None = None, limit: int = FILTER_EDGES) -> DataFrame:
    kept = edges.where(F.col("rel_type") == relationship) if relationship else edges
    return first_edges(kept).orderBy("ord").limit(limit)


def prune_nodes(nodes: DataFrame, edges: DataFrame, first: int = FIRST_NODES) -> DataFrame:
    """Nodes that an edge still names, and the first ones by position; ``ord`` counts from 0 by position."""
    placed = nodes.withColumn("at", F.expr("row_number() over (order by ord) - 1"))
    named = edges.select(F.explode(F.array("source_id", "target_id")).alias("named")).distinct()
    return placed.join(named, F.col("id") == F.col("named"), "left").where(F.col("named").isNotNull() | (F.col("at") < first)).drop("at", "named")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def edge_points(relationship: str | None, question: str, source_name: Column, target_name: Column) -> Column:
    """An edge's score in hundredths. Words are split at white space only, their punctuation kept."""
    kind, low = F.col("rel_type"), F.lower("rel_type")
    by_type = F.lit(0)
    if relationship:
        part = F.lit(False)
        for p in relationship.lower().split("_"):
            part = part | low.contains(p)
        by_type = F.when(kind == relationship, TYPE).when(part, TYPE_PART).otherwise(0)
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(question.lower().split())]).cast("array<string>")
    words = lambda name: F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    shared = F.size(F.array_intersect(F.concat(words(source_name), words(target_name)), asked))
    return F.least(F.lit(100), BASE + by_type + F.least(F.lit(WORDS), shared * WORD) + F.when(F.length(kind) > 3, LONG_TYPE).otherwise(0) + F.when(kind.contains("_"), COMPOUND).otherwise(0))


def score_edges(edges: DataFrame, names: DataFrame, relationship: str | None, question: str, limit: int = SCORED_EDGES) -> DataFrame:
    """Edges with ``points``, best first, equal ones by ``ord``."""
    name = lambda end: names.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    scored = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left").withColumn("points", edge_points(relationship, question, F.col("source_name"), F.col("target_name")))
    return scored.select("source_id", "rel_type", "target_id", "ord", "points").orderBy(F.desc("points"), "ord").limit(limit)


def rel_histogram(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(rel_type, n, example): edges per type and the first of them, most first."""
    name = lambda end: names.select(F.col("id").alias(f"{end}_id"), F.coalesce(F.nullif("name", F.lit("")), "label").alias(f"{end}_name"))
    shown = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    example = F.concat(F.coalesce("source_name", F.lit("?")), F.lit(" → "), F.coalesce("target_name", F.lit("?")))
    return shown.groupBy("rel_type").agg(F.count("*").alias("n"), F.min_by(example, "ord").alias("example"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").select("rel_type", "n", "example")


def label_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").select("label", "n")


def context_lines(nodes: DataFrame, edges: DataFrame, templates: dict[str, str], limit: int = CONTEXT_EDGES) -> DataFrame:
    """(section, ord, line): an entity line per node, a filled template per distinct edge."""
    entity = F.concat(F.lit("  - ["), "label", F.lit("] "), F.coalesce(F.nullif("name", F.lit("")), F.lit("(unnamed)")))
    lines = nodes.select(F.lit(1).alias("section"), "ord", entity.alias("line"))
    name = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.coalesce(F.nullif("name", F.lit("")), "label").alias(f"{end}_name"))
    few = first_edges(edges).orderBy("ord").limit(limit)
    shown = few.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]), F.col("rel_type")) if templates else F.lit(None).cast("string")
    template = F.coalesce(own, F.concat(F.lit("{source} --"), "rel_type", F.lit("--> {target}")))
    text = F.concat(F.lit("  - "), fill(template, F.coalesce("source_name", F.lit("Unknown")), F.coalesce("target_name", F.lit("Unknown"))))
    return lines.unionByName(shown.select(F.lit(2).alias("section"), "ord", text.alias("line")))


def merge_nodes(parts: DataFrame) -> DataFrame:
    """Nodes of several results (part, ord, id, ...), each id where it comes first."""
    rest = [c for c in parts.columns if c not in ("id", "part", "ord")]
    return parts.groupBy("id").agg(F.min_by(F.struct("part", "ord", *rest), F.struct("part", "ord")).alias("x")).select("id", "x.*")
