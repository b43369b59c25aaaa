"""Schema discovery: labels, patterns, property profiles and what can be searched, each one plan over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_key, strings
from ..sources.graph import Graph

# Property names that identify an entity.
NAME_PATTERNS = """
name title label display_name displayname
full_name fullname common_name commonname
brand_name brandname generic_name genericname
short_name shortname identifier id_name
heading subject description summary
""".split()
# What a property's name, uniqueness and type add to its score, in hundredths, and the score it must exceed.
NAME_POINTS, UNIQUE_POINTS, STRING_POINTS, ENOUGH = 40, 30, 30, 50
SAMPLES = 3
#: Names that the wider scorer also takes for identifying ones.
WIDER_NAMES = [*NAME_PATTERNS, "email"]


def labels(graph: Graph) -> DataFrame:
    return graph.nodes.select("label").distinct().orderBy("label")


def node_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("label").agg(F.count("*").alias("n"))


def relationship_patterns(graph: Graph) -> DataFrame:
    """Edges per (type, source label, target label), most first."""
    e = graph.edges.groupBy("rel_type", "source_label", "target_label").agg(F.count("*").alias("n"))
    return e.orderBy(F.desc("n"), "rel_type", "source_label", "target_label")


def totals(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("total_nodes"))
    return n.join(graph.edges.agg(F.count("*").alias("total_relationships")))


def property_keys(graph: Graph) -> DataFrame:
    return graph.properties.select("label", "key").distinct()


def property_profile(graph: Graph, approximate: bool = False) -> DataFrame:
    """For each label and key: values, distinct values, their ratio, the least three as samples, and the type of the first sample.

    Without values the type is Unknown, the ratio 0 and there are no samples. The samples
    come from one row per distinct value, so no list of a key's values is ever held. With
    ``approximate`` the distinct count is a sketch's, which spares the shuffle of values.
    """
    keys = graph.properties.groupBy("label", "key").agg(F.count("value").alias("n_values"), *([F.approx_count_distinct("value").alias("n_distinct")] if approximate else []))
    values = graph.properties.where("value is not null")
    least = values
    for i in range(SAMPLES):  # three minima: partial aggregation, no window over a key's values
        if i:
            last = found.select("label", "key", F.col(f"s{i - 1}").alias("last"))
            least = values.join(last, ["label", "key"]).where("value > last").drop("last")
        here = least.groupBy("label", "key").agg(F.min(F.struct("value", "type")).alias("m")).select("label", "key", F.col("m.value").alias(f"s{i}"), *([F.col("m.type").alias("type")] if not i else []))
        found = here if not i else found.join(here, ["label", "key"], "left")
    if not approximate:
        keys = keys.join(values.groupBy("label", "key").agg(F.count_distinct("value").alias("n_distinct")), ["label", "key"], "left")
    sample = F.array_compact(F.array(*[f"s{i}" for i in range(SAMPLES)]))
    out = keys.join(found, ["label", "key"], "left")
    ratio = F.when(F.col("n_values") > 0, F.col("n_distinct") / F.col("n_values")).otherwise(0.0)
    return out.select("label", "key", "n_values", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), F.round(ratio, 6).alias("unique_ratio"), F.coalesce("type", F.lit("Unknown")).alias("type"), sample.alias("sample"))


def searchable(profile: DataFrame, names: list[str] = NAME_PATTERNS) -> DataFrame:
    """(label, key): properties that score over the mark by name, uniqueness and type; of a label without any, its first String."""
    named = F.array_contains(strings(names), plain_key(F.col("key"))) | F.array_contains(strings(names), F.lower("key"))
    points = F.when(named, NAME_POINTS).otherwise(0) + F.when(F.col("unique_ratio") > 0.5, UNIQUE_POINTS).otherwise(0) + F.when(F.col("type") == "String", STRING_POINTS).otherwise(0)
    scored = profile.select("label", "key", "type", points.alias("points"))
    best = scored.groupBy("label").agg(F.max("points").alias("best"), F.min(F.when(F.col("type") == "String", F.col("key"))).alias("first"))
    return scored.join(best, "label").where((F.col("points") > ENOUGH) | ((F.col("best") <= ENOUGH) & (F.col("key") == F.col("first")))).select("label", "key", "points")


def discover(graph: Graph) -> dict:
    """The schema document; what is collected has one entry per label, pattern or property."""
    counts = {r.label: r.n for r in node_counts(graph).collect()}
    profile = property_profile(graph).collect()
    patterns = [{"type": r.rel_type, "source_label": r.source_label, "target_label": r.target_label, "count": r.n} for r in relationship_patterns(graph).collect()]
    props: dict[str, list[dict]] = {x: [] for x in sorted(counts)}
    for r in sorted(profile, key=lambda r: (r.label, r.key)):
        props.setdefault(r.label, []).append({"name": r.key, "type": r.type, "unique_ratio": r.unique_ratio, "sample": list(r.sample)})
    frame = graph.spark.createDataFrame([(r.label, r.key, r.type, r.unique_ratio) for r in profile], "label string, key string, type string, unique_ratio double")
    can: dict[str, list[str]] = {x: [] for x in sorted(counts)}
    for r in searchable(frame).orderBy("label", "key").collect():
        can[r.label].append(r.key)
    return {"node_labels": sorted(counts), "relationships": patterns, "properties": props, "searchable_properties": can, "node_counts": counts, "total_nodes": sum(counts.values()), "total_relationships": sum(p["count"] for p in patterns)}


def top_degree(graph: Graph, label: str, k: int = 5) -> DataFrame:
    """(id, name, degree): the nodes of a label with the most outgoing edges, those without none left out."""
    degree = graph.edges.where(F.col("source_label") == label).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("degree"))
    return degree.join(graph.labelled([label]).select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(k)


def cardinality(graph: Graph) -> DataFrame:
    """For each relationship type: the most edges out of a source and into a target, and the class by whether they exceed 1."""
    side = lambda end, name: graph.edges.groupBy("rel_type", end).agg(F.count("*").alias("d")).groupBy("rel_type").agg(F.max("d").alias(name))
    many = lambda c: F.col(c) > 1
    kind = F.when(~many("max_out") & ~many("max_in"), "1:1").when(many("max_out") & ~many("max_in"), "1:N").when(~many("max_out"), "N:1").otherwise("M:N")
    return side("source_id", "max_out").join(side("target_id", "max_in"), "rel_type").withColumn("cardinality", kind)


def constraints(graph: Graph) -> DataFrame:
    """MANDATORY where every node of the label has a value, else OPTIONAL."""
    have = graph.properties.groupBy("label", "key").agg(F.count("value").alias("n_values"))
    return have.join(node_counts(graph), "label").select("label", "key", F.when(F.col("n_values") == F.col("n"), "MANDATORY").otherwise("OPTIONAL").alias("constraint"))


def cardinality_bounds(graph: Graph) -> DataFrame:
    """(rel_type, source_label, target_label, notation): ``[least..most] edges out of a source and into a target``; the least is 0 where some node of the label has none."""
    of = ["rel_type", "source_label", "target_label"]
    n = node_counts(graph)

    def side(end: str) -> DataFrame:
        degree = graph.edges.groupBy(*of, f"{end}_id").agg(F.count("*").alias("d")).groupBy(*of).agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("have"))
        sized = degree.join(n.select(F.col("label").alias(f"{end}_label"), "n"), f"{end}_label", "left")
        low = F.when(F.col("have") < F.col("n"), 0).otherwise(F.col("low"))
        return sized.select(*of, F.concat(F.lit("["), low.cast("string"), F.lit(".."), F.col("high").cast("string"), F.lit("]")).alias(end))

    return side("source").join(side("target"), of).select(*of, F.concat("source", F.lit(" -> "), "target").alias("notation"))
