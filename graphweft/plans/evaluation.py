"""A suite of cases run through a pipeline, and its verdicts as a plan."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "name string, category string, intent string, strategy string, facts int, rel_types array<string>, answer string, called_model boolean, latency_ms double"
CASE = "name string, expect_intent string, expect_strategy string, expect_min_facts int, expect_rel_types array<string>, expect_no_rel_types array<string>, expect_answer_contains array<string>, expect_no_llm_call boolean, max_latency_ms double"


@dataclass(frozen=True)
class Case:
    name: str
    category: str
    query: str
    expect_intent: str | None = None
    expect_strategy: str | None = None
    expect_min_facts: int = 0
    expect_rel_types: tuple[str, ...] | None = None
    expect_no_rel_types: tuple[str, ...] | None = None
    expect_answer_contains: tuple[str, ...] | None = None
    expect_no_llm_call: bool = False
    max_latency_ms: float = 30_000.0


def verdicts(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(name, category, passed, details): every check a case states that its result fails."""
    j = results.join(cases, "name")
    odd = F.array_except("rel_types", "expect_rel_types")
    barred = F.array_intersect("rel_types", "expect_no_rel_types")
    missing = F.filter("expect_answer_contains", lambda s: ~F.lower("answer").contains(F.lower(s)))
    said = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text)
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    failures = F.array_compact(F.array(
        said(F.col("expect_intent") != F.col("intent"), F.concat(F.lit("intent "), "intent")),
        said(F.col("expect_strategy") != F.col("strategy"), F.concat(F.lit("strategy "), "strategy")),
        said(F.col("facts") < F.col("expect_min_facts"), F.concat(F.lit("facts "), F.col("facts").cast("string"))),
        said(F.size(odd) > 0, F.concat(F.lit("unexpected "), listed(odd))),
        said(F.size(barred) > 0, F.concat(F.lit("forbidden "), listed(barred))),
        said(F.col("answer").isNotNull() & (F.size(missing) > 0), F.concat(F.lit("missing "), listed(missing))),
        said(F.col("expect_no_llm_call") & F.col("called_model"), F.lit("called the model")),
        said(F.col("latency_ms") > F.col("max_latency_ms"), F.lit("too slow")),
    ))
    return j.select("name", "category", (F.size(failures) == 0).alias("passed"), F.when(F.size(failures) == 0, "PASS").otherwise(F.array_join(failures, "; ")).alias("details"))


def pass_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)) * 100, 4).alias("pass_rate"))


def run(spark: SparkSession, pipeline, cases: list[Case]) -> DataFrame:
    """Results of a list of cases; a case whose question fails outright fails by its intent ``error``."""
    rows = []
    for c in cases:
        began = time.perf_counter()
        try:
            r = pipeline.query(c.query)
            rel = sorted({e["rel_type"] for e in r.subgraph["relationships"]})
            row = (r.intent, r.strategy, len(r.subgraph["relationships"]), rel, r.answer, "llm_ms" in r.timing)
        except Exception:
            row = ("error", "error", -1, [], None, False)
        rows.append((c.name, c.category, *row, (time.perf_counter() - began) * 1000))
    wanted = [(c.name, c.expect_intent, c.expect_strategy, c.expect_min_facts, *(list(x) if x is not None else None for x in (c.expect_rel_types, c.expect_no_rel_types, c.expect_answer_contains)), c.expect_no_llm_call, c.max_latency_ms) for c in cases]
    return verdicts(spark.createDataFrame(rows, RESULT), spark.createDataFrame(wanted, CASE))
