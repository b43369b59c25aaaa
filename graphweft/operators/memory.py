"""Episodic memory: past questions with their answers and vectors, a Parquet table partitioned by domain."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine

SCHEMA = "id string, query_text string, query_embedding array<float>, answer string, context string, intent string, strategy string, quality_score double, subgraph_json string, domain string, timestamp double"
# How many of a domain's newest memories recall looks at, how near they must be and how many come back; seconds of a recent memory.
SCAN, THRESHOLD, RESULTS, RECENT = 500, 0.85, 3, 3600


def recall(memories: DataFrame, query: Column, domain: str, now: float, threshold: float = THRESHOLD, limit: int = RESULTS, scan: int = SCAN) -> DataFrame:
    """(id, query_text, answer, context, intent, similarity, age_seconds), nearest first.

    The domain prunes partitions; the newest ``scan`` rows come by a top-k, without a sort of the table.
    """
    newest = memories.where((F.col("domain") == domain) & F.col("query_embedding").isNotNull()).orderBy(F.desc("timestamp"), "id").limit(scan)
    scored = newest.select("id", "query_text", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("intent", F.lit("")).alias("intent"), F.round(cosine(F.col("query_embedding"), query), 6).alias("similarity"), (F.lit(float(now)) - F.col("timestamp")).alias("age_seconds"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "age_seconds", "id").limit(limit)


def stats(memories: DataFrame, now: float, domain: str | None = None, recent: float = RECENT) -> DataFrame:
    rows = memories.where(F.col("domain") == domain) if domain is not None else memories
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("timestamp") > F.lit(float(now) - recent)).alias("last_hour"))


@dataclass
class Memory:
    """A memory table at a path, and the session's own questions."""

    spark: SparkSession
    path: str
    embed: object = None
    session: dict = field(default_factory=dict)

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception:
            return self.spark.createDataFrame([], SCHEMA)

    def store(self, query: str, answer: str, context: str = "", intent: str = "", strategy: str = "", quality: float = 0.0, subgraph_json: str = "", domain: str = "default", now: float | None = None) -> None:
        """Append one memory; a failing embedding is stored as null."""
        now = time.time() if now is None else now
        row = (f"{now:.6f}-{hashlib.sha256(query.encode()).hexdigest()[:12]}", query, self._vector(query), answer, context, intent, strategy, float(quality), subgraph_json, domain, float(now))
        self.spark.createDataFrame([row], SCHEMA).write.mode("append").partitionBy("domain").parquet(self.path)
        self.session[query] = {"answer": answer, "context": context, "intent": intent}

    def _vector(self, query: str) -> list[float] | None:
        try:
            return [float(x) for x in self.embed(query)] if self.embed else None
        except Exception:
            return None

    def recall(self, query: str, domain: str = "default", threshold: float = THRESHOLD, limit: int = RESULTS, now: float | None = None) -> list[dict]:
        if query in self.session:
            return [{"query_text": query, **self.session[query], "similarity": 1.0, "age_seconds": 0.0}]
        vector = self._vector(query)
        if vector is None:
            return []
        literal = F.array(*[F.lit(x) for x in vector])
        return [r.asDict() for r in recall(self.table(), literal, domain, time.time() if now is None else now, threshold, limit).collect()]

    def stats(self, domain: str | None = None, now: float | None = None) -> dict:
        return stats(self.table(), time.time() if now is None else now, domain).first().asDict() | {"session": len(self.session)}

    def clear_session(self) -> None:
        self.session.clear()
