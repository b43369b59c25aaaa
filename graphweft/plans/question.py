"""A question's way through the graph: entries, intent, traversal, filter, score, text.

The driver holds what a question yields: some entries and some dozen edges. All that reads
the graph is a Spark plan over it.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators import ranking, retrieval
from ..operators.traverse import EDGE, Pattern, Subgraph, traverse
from ..sources.graph import Graph
from .model import LanguageModel, answer

OUT_OF_SCOPE = "No entity of this question is in the knowledge graph, so it is outside its scope."
NOTHING = "No matching information found."
SUFFICIENT = 5


@dataclass
class Result:
    query: str
    entry_nodes: list[str] = field(default_factory=list)
    intent: str = "out_of_scope"
    strategy: str = "none"
    hop_depth: int = 0
    subgraph: dict = field(default_factory=lambda: {"nodes": [], "relationships": []})
    context: str = ""
    answer: str | None = None
    thought_process: list[dict] = field(default_factory=list)
    timing: dict[str, float] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


class QuestionPipeline:
    """Answers questions over one graph by one configuration."""

    def __init__(self, graph: Graph, config: dict, model: LanguageModel | None = None, vectors: DataFrame | None = None):
        """``vectors`` (id, label, embedding), made by the same model, let names and whole questions match by meaning."""
        self.graph, self.config, self.model, self.vectors = graph, config, model, vectors
        self.patterns = {name: Pattern.of(spec) for name, spec in config["intent_patterns"].items()}
        rows = [(i, name, list(p.keywords)) for i, (name, p) in enumerate(self.patterns.items())]
        self.intents: DataFrame = graph.spark.createDataFrame(rows, "ord int, name string, keywords array<string>")
        self.templates = config.get("relationship_templates", {})
        self.node_limit = config.get("general_traversal", {}).get("node_limit", 30)

    def entries(self, question: str) -> list[dict]:
        """Nodes the question names, by candidate; else those the model names; else the busiest of a label it mentions; else those nearest to it by meaning."""
        if not question.strip():
            return []
        found = self._matched(question)
        if not found and self.model is not None:
            found = self._matched_by_model(question)
        if not found:
            top = retrieval.label_match(self.graph, question, sorted(self.graph.searchable))
            found = [{"id": r.id, "name": r.name} for r in top.collect()] if top is not None else []
        return found or self._meant(question)

    def _asked(self, texts: list[str]) -> DataFrame | None:
        """(candidate, asked): texts and their vectors; None without a model and vectors to compare with, or if the model fails."""
        if self.model is None or self.vectors is None or not texts:
            return None
        try:
            rows = [(t, [float(x) for x in self.model.embed_text(t)]) for t in texts]
        except Exception:
            return None
        return self.graph.spark.createDataFrame(rows, "candidate string, asked array<double>")

    def _meant(self, question: str) -> list[dict]:
        asked = self._asked([question])
        if asked is None:
            return []
        near = retrieval.match_semantic(self.vectors, asked, limit=retrieval.SEMANTIC_WHOLE).join(self.graph.nodes.select("id", "name"), "id")
        return [{"id": r.id, "name": r.name} for r in sorted(near.collect(), key=lambda r: (-r.score, r.id))]

    def _matched(self, question: str) -> list[dict]:
        asked = self.graph.spark.createDataFrame([(0, question)], "query_id int, text string")
        names = [r.candidate for r in retrieval.candidates(asked).collect()] if self.vectors is not None else []
        found = retrieval.extract(self.graph, asked, vectors=self.vectors, asked=self._asked([n for n in names if len(n) > retrieval.SEMANTIC_LENGTH]))
        hits = found.join(self.graph.nodes.select("id", "name"), "id")
        return [{"id": r.id, "name": r.name} for r in sorted(hits.collect(), key=lambda r: (r.ord, r.id))]

    def _matched_by_model(self, question: str) -> list[dict]:
        try:
            reply = self.model.generate_text(f"Name the entities in this question, separated by commas.\nQuestion: {question}")
        except Exception:
            return []
        found: dict[str, dict] = {}
        for name in (x.strip() for x in reply.split(",")):
            for node in self._matched(name) if name else []:
                found.setdefault(node["id"], node)
        return list(found.values())

    def intent(self, question: str) -> str:
        """By keywords; where they decide nothing, by the model if it names a known intent."""
        low = question.lower()
        hit = next((n for n, p in self.patterns.items() if any(k.lower() in low for k in p.keywords)), None)
        if hit is None and any(m in low for m in retrieval.ABSTRACT_MARKERS):
            return "abstract"
        if self.model is not None:
            try:
                choices = "\n".join(f"{n}: {p.description or 'Search for ' + n}" for n, p in self.patterns.items())
                reply = self.model.generate_text(f"Which of these intents fits the question? Reply with its name.\n{choices}\nQuestion: {question}")
                name = "".join(c for c in reply if c.isalnum() or c == "_").lower()
                if name in self.patterns:
                    return name
            except Exception:
                pass
        return hit or "general"

    def retrieve(self, question: str, entries: list[dict], intent: str) -> dict:
        """The traversed subgraph, filtered and scored, as lists; abstract questions look around."""
        found: Subgraph = traverse(self.graph, [e["id"] for e in entries], self.patterns, "neighborhood" if intent == "abstract" else intent, self.node_limit)
        relationship = self.patterns[intent].relationship if intent in self.patterns else ""
        nodes = [r.asDict() for r in found.nodes.orderBy("ord").collect()]
        edges = [r.asDict() for r in found.edges.select(*EDGE, "ord").orderBy("ord").collect()]
        spark = self.graph.spark
        if edges:
            node_rows = spark.createDataFrame([(n["id"], n["label"], n["name"], n["ord"]) for n in nodes], "id string, label string, name string, ord int")
            edge_rows = spark.createDataFrame([tuple(e[c] for c in (*EDGE, "ord")) for e in edges], ", ".join(f"{c} string" for c in EDGE) + ", ord int")
            kept = ranking.filter_edges(edge_rows, relationship or None)
            left = ranking.prune_nodes(node_rows, kept)
            best = ranking.score_edges(kept, left, relationship or None, question)
            nodes = [r.asDict() for r in ranking.prune_nodes(left, best).orderBy("ord").collect()]
            edges = [r.asDict() for r in best.collect()]
        return {"nodes": nodes, "relationships": edges, "strategy": found.strategy, "hop_depth": found.hop_depth}

    def context(self, found: dict, intent: str) -> str:
        nodes, edges = found["nodes"], found["relationships"]
        names = {n["id"]: n["name"] or n["label"] for n in nodes}
        if intent == "abstract":
            if not edges:
                return ""
            kinds, labels = Counter(e["rel_type"] for e in edges), Counter(n["label"] for n in nodes)
            first = {e["rel_type"]: e for e in reversed(edges)}
            example = lambda e: f"{names.get(e['source_id'], '?')} → {names.get(e['target_id'], '?')}"
            lines = ["RELATIONSHIP PATTERNS (sorted by frequency):", *(f'  - {k}: {n} instance(s) — e.g., "{example(first[k])}"' for k, n in kinds.most_common())]
            return "\n".join([*lines, "\nENTITY TYPES:", *(f"  - {k}: {n} node(s)" for k, n in labels.most_common())])
        if not nodes:
            return ""
        lines = ["ENTITIES:", *(f"  - [{n['label']}] {n['name'] or '(unnamed)'}" for n in nodes)]
        if edges:
            unique = list({(e["source_id"], e["target_id"], e["rel_type"]): e for e in reversed(edges)}.values())[::-1][: ranking.CONTEXT_EDGES]
            lines.append("\nRELATIONSHIPS:")
            for e in unique:
                template = self.templates.get(e["rel_type"], "{source} --" + e["rel_type"] + "--> {target}")
                lines.append("  - " + template.replace("{source}", names.get(e["source_id"], "Unknown")).replace("{target}", names.get(e["target_id"], "Unknown")))
        return "\n".join(lines)

    def query(self, question: str, max_retries: int = 2) -> Result:
        """The best of up to ``max_retries`` + 1 attempts; later ones ask what the model suggests instead, so without a model there is one."""
        out, clock = Result(question), time.perf_counter
        began = clock()
        entries = self.entries(question)
        out.timing["domain_guard_ms"] = round((clock() - began) * 1000, 1)
        if not entries:
            out.answer = OUT_OF_SCOPE
            out.thought_process.append({"step": 0, "action": "domain_guard", "result": "rejected", "reason": "no_matching_entities"})
            return out
        asked, best, out.intent = question, 0, "none"
        for attempt in range(max_retries + 1):
            if attempt:
                entries = self.entries(asked)
                if not entries:
                    out.thought_process.append({"step": attempt + 1, "action": "re-extract", "result": "no_entities"})
                    continue
            intent = self.intent(asked)
            began = clock()
            found = self.retrieve(asked, entries, intent)
            out.timing[f"step{attempt}_traverse_ms"] = round((clock() - began) * 1000, 1)
            quality = len(found["nodes"]) + len(found["relationships"])
            if quality > best:
                best, out.intent, out.subgraph, out.context = quality, intent, found, self.context(found, intent)
            out.thought_process.append({"step": attempt + 1, "query": asked, "nodes": [e["name"] for e in entries], "intent": intent, "found_facts": len(found["relationships"]), "quality_score": quality})
            if best >= SUFFICIENT or attempt == max_retries:
                break
            suggested = self._replan(question, out.context)
            if suggested is None:
                break
            asked = suggested
        out.strategy, out.hop_depth = out.subgraph.get("strategy", "unknown"), out.subgraph.get("hop_depth", 0)
        out.entry_nodes = [n["name"] or "" for n in out.subgraph["nodes"]]
        if self.model is not None and out.context:
            began = clock()
            try:
                out.answer = answer(self.model, question, out.context)
            except Exception:
                out.answer = "The answer could not be put into words; these are the facts found.\n\n" + out.context
            out.timing["llm_ms"] = round((clock() - began) * 1000, 1)
        out.context = out.context or NOTHING
        return out

    def _replan(self, question: str, context: str) -> str | None:
        if self.model is None:
            return None
        try:
            reply = self.model.generate_text(f"Suggest other search words for this question, under 50 characters.\nQuestion: {question}\nFound so far:\n{context}").strip()
        except Exception:
            return None
        return reply if 0 < len(reply) < 50 else None
