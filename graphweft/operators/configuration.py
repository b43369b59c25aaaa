"""Intents and text templates derived from a discovered schema, as plans over its relationship patterns."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import humanize, intent_name, past_participle, template_for

PATTERN_SCHEMA = "ord int, type string, source_label string, target_label string"
# The intents every graph has, and the order of strategies.
STRUCTURAL = {
    "neighborhood": {
        "strategy": "variable_hop",
        "keywords": ["everything about", "overview of", "related to", "all about", "full profile", "tell me about", "information about", "details of"],
        "min_hops": 1,
        "max_hops": 2,
    },
    "connection": {
        "strategy": "shortest_path",
        "keywords": ["connected", "how is", "what connects", "path between", "link between", "relationship between", "how are", "related to each other"],
        "max_hops": 6,
    },
    "shared": {
        "strategy": "shared_neighbor",
        "keywords": ["in common", "share", "both", "same", "common", "mutual", "overlap"],
        "min_connections": 2,
    },
}
PRIORITY = ["chained", "shared_neighbor", "shortest_path", "variable_hop", "targeted"]
NODE_LIMIT = 50


def ranked_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns (rel_type, source_label, target_label, n) with ``ord`` in their order; one row per pattern, so one window is no bottleneck."""
    at = F.expr("cast(row_number() over (order by n desc, rel_type, source_label, target_label) as int) - 1")
    return patterns.select(at.alias("ord"), F.col("rel_type").alias("type"), "source_label", "target_label")


def forward_keywords(kind: Column, target: Column) -> Column:
    human, t = humanize(kind), humanize(target)
    words = F.filter(F.split(human, " "), lambda w: F.length(w) > 3)
    whole = F.array(human, F.concat(t, F.lit(" of")), F.concat(F.lit("what "), t), F.concat(F.lit("what does it "), human), F.concat(human, F.lit(" "), t))
    return F.array_sort(F.array_distinct(F.concat(whole, words)))


def reverse_keywords(kind: Column, source: Column) -> Column:
    human, s = humanize(kind), humanize(source)
    return F.array_sort(F.array_distinct(F.array(F.concat(past_participle(human), F.lit(" by")), F.concat(F.lit("what "), human), F.concat(F.lit("which "), s), F.concat(F.lit("what "), s))))


def targeted_intents(patterns: DataFrame) -> DataFrame:
    """A forward and a reverse intent per pattern; of equal names the first pattern's."""
    forward = patterns.select((F.col("ord") * 2).alias("ord"), intent_name(F.col("source_label"), F.col("type")).alias("name"), forward_keywords(F.col("type"), F.col("target_label")).alias("keywords"), "type", "source_label", "target_label", F.lit("source").alias("anchor"))
    reverse = patterns.select((F.col("ord") * 2 + 1).alias("ord"), intent_name(F.col("target_label"), F.concat("type", F.lit("_reverse"))).alias("name"), reverse_keywords(F.col("type"), F.col("source_label")).alias("keywords"), "type", "source_label", "target_label", F.lit("target").alias("anchor"))
    every = forward.unionByName(reverse)
    return every.groupBy("name").agg(F.min_by(F.struct("ord", "keywords", "type", "source_label", "target_label", "anchor"), "ord").alias("x")).select("name", "x.*")


def chains(patterns: DataFrame) -> DataFrame:
    """Couples of patterns that meet in a label, of different types and not back to where they began."""
    a, b = (patterns.select(*[F.col(c).alias(f"{p}_{c}") for c in patterns.columns]) for p in ("a", "b"))
    joined = a.join(b, F.col("a_target_label") == F.col("b_source_label")).where((F.col("a_type") != F.col("b_type")) & (F.col("b_target_label") != F.col("a_source_label")))
    h1, h2 = humanize(F.col("a_type")), humanize(F.col("b_type"))
    name = F.concat(F.lit("chain_"), F.replace(h1, F.lit(" "), F.lit("_")), F.lit("_to_"), F.replace(h2, F.lit(" "), F.lit("_")))
    words = F.array(F.concat(F.lit("indirectly "), h2), F.concat(h1, F.lit(" then "), h2), F.concat(F.lit("through "), humanize(F.col("a_target_label"))), F.concat(F.lit("leads to "), humanize(F.col("b_target_label"))))
    return joined.select("a_ord", "b_ord", name.alias("name"), F.col("a_source_label").alias("entry_label"), F.col("a_type").alias("type1"), F.col("a_target_label").alias("label1"), F.col("b_type").alias("type2"), F.col("b_target_label").alias("label2"), words.alias("keywords"))


def chained_intents(patterns: DataFrame) -> DataFrame:
    """Chains by name; of equal names the last."""
    c = chains(patterns)
    rest = ["entry_label", "type1", "label1", "type2", "label2", "keywords"]
    return c.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("a_ord", "b_ord")).alias("x")).select("name", "x.*")


def intents(patterns: DataFrame) -> DataFrame:
    """(name, strategy, keywords, ord): every intent in the order they are tried."""
    spark = patterns.sparkSession
    fixed = spark.createDataFrame([(n, s["strategy"], s["keywords"]) for n, s in STRUCTURAL.items()], "name string, strategy string, keywords array<string>")
    every = targeted_intents(patterns).select("name", F.lit("targeted").alias("strategy"), "keywords").unionByName(chained_intents(patterns).select("name", F.lit("chained").alias("strategy"), "keywords"))
    every = every.join(fixed.select("name"), "name", "left_anti").unionByName(fixed)
    priority = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("strategy"))
    return every.select("name", "strategy", "keywords", priority.alias("priority")).select("name", "strategy", "keywords", F.expr("cast(row_number() over (order by priority, name) as int) - 1").alias("ord"))


def templates(patterns: DataFrame) -> DataFrame:
    return patterns.select("type").distinct().select("type", template_for(humanize(F.col("type"))).alias("template"))


def generate(spark: SparkSession, schema: dict) -> dict:
    """The configuration document of a schema document."""
    rows = [(i, p["type"], p["source_label"], p["target_label"]) for i, p in enumerate(schema["relationships"])]
    patterns = spark.createDataFrame(rows, PATTERN_SCHEMA)
    specs: dict[str, dict] = {}
    for r in targeted_intents(patterns).orderBy("ord").collect():
        specs[r.name] = {"strategy": "targeted", "keywords": list(r.keywords), "source_label": r.source_label, "relationship": r.type, "target_label": r.target_label, "entry_anchor": r.anchor}
    for r in chained_intents(patterns).collect():
        specs[r.name] = {"strategy": "chained", "keywords": list(r.keywords), "entry_label": r.entry_label, "hops": [{"relationship": r.type1, "target_label": r.label1}, {"relationship": r.type2, "target_label": r.label2}]}
    specs |= STRUCTURAL
    return {
        "domain": "auto-discovered",
        "description": "Discovered graph of " + ", ".join(schema["node_labels"]),
        "auto_generated": True,
        "intent_patterns": dict(sorted(specs.items(), key=lambda kv: (PRIORITY.index(kv[1]["strategy"]), kv[0]))),
        "relationship_templates": {r.type: r.template for r in templates(patterns).collect()},
        "general_traversal": {"node_limit": NODE_LIMIT},
    }


def load(source: str | dict, folder: str = "") -> dict:
    """A configuration given as a dict, the path of a JSON file, or the name of ``<folder>/<name>_graph.json``; FileNotFoundError if there is none."""
    if isinstance(source, dict):
        return source
    path = Path(source)
    if not path.suffix:
        path = Path(folder) / f"{source}_graph.json"
    return json.loads(path.read_text())
