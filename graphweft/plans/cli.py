"""Ask a saved graph from the command line: ``python -m graphweft.plans.cli GRAPH [--seed] [QUESTION]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import configuration, schema
from ..sources import graph as graphs
from ..sources import sample
from .question import QuestionPipeline

DEMO = ["What are the side effects of aspirin?", "What treats headaches?", "How is aspirin connected to peptic ulcer?"]


def describe(document: dict) -> str:
    """A schema document in lines."""
    lines = [f"{document['total_nodes']} nodes, {document['total_relationships']} relationships"]
    lines += [f"  {label}: {n}, searched by {', '.join(document['searchable_properties'].get(label, [])) or 'nothing'}" for label, n in document["node_counts"].items()]
    return "\n".join(lines + [f"  ({p['source_label']})-[{p['type']}]->({p['target_label']}): {p['count']}" for p in document["relationships"]])


def describe_config(config: dict) -> str:
    return "\n".join(f"  {name} ({spec['strategy']}): {', '.join(spec['keywords'])}" for name, spec in config["intent_patterns"].items())


def show(result) -> str:
    return f"intent {result.intent}, strategy {result.strategy}\n{result.context}\n" + (f"\n{result.answer}\n" if result.answer else "")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("graph", help="folder of a saved graph")
    p.add_argument("question", nargs="?")
    p.add_argument("--seed", action="store_true", help="write the sample graph there first")
    p.add_argument("--demo", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.seed:
        graphs.build(spark, sample.NODES, sample.RELATIONSHIPS).save(a.graph)
    g = graphs.load(spark, a.graph)
    document = schema.discover(g)
    g = graphs.load(spark, a.graph, document["searchable_properties"])
    config = sample.CONFIG if a.seed else configuration.generate(spark, document)
    pipeline = QuestionPipeline(g, config)
    print(describe(document))
    for q in [a.question] if a.question else DEMO if a.demo else iter(lambda: input("? ").strip(), ""):
        print(show(pipeline.query(q)))


if __name__ == "__main__":
    main()
