"""Staged construction of a graph from texts: chunks, triples, types, resolution, build, discovery."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import construction, schema
from ..sources.graph import Graph, merge
from ..sources.shared import checkpoint
from .model import LanguageModel

PROMPT = "List the facts of this text as a JSON array of objects with head, relation, tail, head_type, tail_type and confidence.\n\n"


@dataclass
class BuildResult:
    triples: DataFrame | None = None
    types: DataFrame | None = None
    relations: DataFrame | None = None
    resolved: DataFrame | None = None
    canonical: DataFrame | None = None
    graph: Graph | None = None
    discovered: dict | None = None
    stages_completed: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def report(self) -> str:
        return "stages: " + (", ".join(self.stages_completed) or "none") + "".join(f"\nerror: {e}" for e in self.errors)


def replies(chunks: DataFrame, model: LanguageModel) -> DataFrame:
    """(chunk, reply) for (chunk, text): the model is called once a chunk, where the chunk is; a failed call replies nothing."""

    def ask(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                try:
                    out.append(model.generate_text(PROMPT + text))
                except Exception:
                    out.append("[]")
            yield pdf.assign(reply=out)[["chunk", "reply"]]

    return chunks.select(F.col("chunk").cast("string").alias("chunk"), "text").mapInPandas(ask, "chunk string, reply string")


def heuristic_reply(text: str) -> str:
    """Facts of sentences of three words or more, a name, a verb and the rest: what a stand-in model can do."""
    facts = []
    for s in text.replace("!", ".").replace("?", ".").split("."):
        w = s.split()
        if len(w) >= 3:
            facts.append({"head": w[0], "relation": w[1], "tail": " ".join(w[2:])})
    return json.dumps(facts)


def run(spark: SparkSession, docs: DataFrame, model: LanguageModel, max_chunk: int = 500, min_confidence: float = 0.0) -> BuildResult:
    """Stages in order over (doc_id, text); the first that fails, or finds nothing, ends the run with an error on record."""
    out = BuildResult()

    def extraction():
        cut = construction.chunk_documents(docs, max_size=max_chunk).select(F.concat_ws("-", "doc_id", "chunk").alias("chunk"), "text")
        out.triples = checkpoint(construction.extract_triples(replies(cut, model), min_confidence=min_confidence))
        if out.triples.isEmpty():
            raise ValueError("No triples extracted")

    def induction():
        out.types, out.relations = construction.induce_types(out.triples), construction.induce_relations(out.triples)

    def resolution():
        out.resolved, out.canonical = construction.resolve_entities(out.triples)

    def build():
        ends = out.resolved.select(F.col("head").alias("name")).unionAll(out.resolved.select(F.col("tail").alias("name"))).distinct()
        none = F.array().cast("array<string>")
        nodes = ends.select("name", F.lit("Entity").alias("label"), none.alias("keys"), none.alias("values"), none.alias("types"))
        out.graph = merge(nodes, out.resolved.select(F.col("head").alias("source"), F.col("relation").alias("type"), F.col("tail").alias("target")))

    def discovery():
        out.discovered = schema.discover(out.graph)

    for stage in (extraction, induction, resolution, build, discovery):
        try:
            stage()
        except Exception as error:
            out.errors.append(f"{stage.__name__}: {str(error).splitlines()[0]}")
            break
        out.stages_completed.append(stage.__name__)
    return out
