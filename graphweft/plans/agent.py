"""An agent that plans sub-questions, answers them, checks what it has and remembers."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.memory import Memory
from .model import LanguageModel, answer
from .question import QuestionPipeline, Result

# Sub-questions of a plan and of its refinement, rounds, retries of a sub-question, facts that suffice, facts of full coverage, similarity of a recalled and of a repeated question, characters of context kept.
PLANNED, REFINED, ROUNDS, RETRIES, ENOUGH, FULL, RECALL, HIT, KEPT = 3, 2, 3, 1, 5, 10, 0.90, 0.95, 2000
NOTHING = "No relevant information was found in the knowledge graph to answer this question."


@dataclass
class AgentResult:
    query: str
    answer: str
    sub_results: list[Result] = field(default_factory=list)
    memory_hit: bool = False
    iterations: int = 0
    timing: dict[str, float] = field(default_factory=dict)


def sub_questions(reply: str, most: int) -> list[str] | None:
    """The strings of a reply that is a JSON array, at most so many; None otherwise."""
    try:
        found = json.loads(reply.strip()) if reply.strip().startswith("[") else None
    except ValueError:
        return None
    return found[:most] if isinstance(found, list) and all(isinstance(x, str) for x in found) else None


def evaluate(facts: list[int], intents: list[str], contexts: list[str]) -> dict:
    """Whether results suffice: all out of scope, or enough facts with some context."""
    if all(i == "out_of_scope" for i in intents):
        return {"sufficient": True, "gaps": [], "coverage": 0.0}
    total, some = sum(facts), any(c.strip() for c in contexts)
    gaps = ([] if some else ["No context retrieved from any sub-question"]) + ([f"Only {total} facts found (need ≥{ENOUGH})"] if total < ENOUGH else [])
    return {"sufficient": total >= ENOUGH and some, "gaps": gaps, "coverage": min(1.0, total / FULL)}


def evaluate_all(results: DataFrame) -> DataFrame:
    """The same for many runs at once: (run, intent, facts, context) to (run, facts, sufficient, coverage)."""
    g = results.groupBy("run").agg(F.sum("facts").alias("facts"), F.min(F.when(F.col("intent") == "out_of_scope", 1).otherwise(0)).alias("none"), F.max(F.when(F.trim(F.coalesce("context", F.lit(""))) != "", 1).otherwise(0)).alias("some"))
    out = F.col("none") == 1
    return g.select("run", "facts", F.when(out, True).otherwise((F.col("facts") >= ENOUGH) & (F.col("some") == 1)).alias("sufficient"), F.when(out, 0.0).otherwise(F.least(F.lit(1.0), F.col("facts") / FULL)).alias("coverage"))


class Agent:
    def __init__(self, pipeline: QuestionPipeline, memory: Memory, model: LanguageModel):
        self.pipeline, self.memory, self.model = pipeline, memory, model

    def _ask(self, prompt: str, most: int) -> list[str] | None:
        try:
            return sub_questions(self.model.generate_text(prompt), most)
        except Exception:
            return None

    def execute(self, query: str, domain: str = "default") -> AgentResult:
        out, clock = AgentResult(query, ""), time.perf_counter
        began = clock()
        known = self.memory.recall(query, domain, RECALL)
        out.timing["memory_recall_ms"] = round((clock() - began) * 1000, 1)
        if known and known[0]["similarity"] >= HIT:
            out.answer, out.memory_hit = known[0]["answer"], True
            return out
        plan = self._ask(f"Split this question into one to {PLANNED} simple ones. Reply with a JSON array of strings.\nQuestion: {query}", PLANNED) or [query]
        for n in range(ROUNDS):
            out.iterations = n + 1
            out.sub_results += [self.pipeline.query(q, RETRIES) for q in plan]
            verdict = evaluate([len(r.subgraph["relationships"]) for r in out.sub_results], [r.intent for r in out.sub_results], [r.context for r in out.sub_results])
            if verdict["sufficient"] or n == ROUNDS - 1:
                break
            gaps = "\n".join(f"- {g}" for g in verdict["gaps"])
            plan = self._ask(f"Question: {query}\nGaps:\n{gaps}\nReply with a JSON array of up to {REFINED} other questions that would fill them.", REFINED) or [query]
        contexts = [r.context for r in out.sub_results if r.context.strip()]
        merged = "\n---\n".join(contexts)
        try:
            out.answer = answer(self.model, query, merged) if contexts else NOTHING
        except Exception:
            out.answer = next((r.answer for r in out.sub_results if r.answer), merged)
        try:
            self.memory.store(query, out.answer, merged[:KEPT], "agent", "multi_step", evaluate([len(r.subgraph["relationships"]) for r in out.sub_results], [r.intent for r in out.sub_results], contexts)["coverage"], json.dumps([r.subgraph for r in out.sub_results]), domain)
        except Exception as error:
            out.timing["memory_store_failed"] = float(bool(error))
        return out
