"""The catalog of graphs: a small Parquet table of what each is, where it is and how it was found."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import graph as graphs
from . import configuration, schema

SCHEMA = "kg_id string, name string, path string, schema_json string, config_json string, status string, created_at double, last_used double"
DEFAULT = "default"


def strategy_counts(intents: DataFrame) -> DataFrame:
    """(strategy, n) of an intent table."""
    return intents.groupBy("strategy").agg(F.count("*").alias("n"))


class Catalog:
    """Entries live in versions of the table: a change writes the next one, so readers always see a whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.open = spark, path, {}

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def table(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        found = self._versions()
        rows.coalesce(1).write.parquet(f"{self.path}/v{found[-1] + 1 if found else 0}")

    def put(self, row: tuple) -> None:
        """Insert or replace by kg_id."""
        self._write(self.table().where(F.col("kg_id") != row[0]).unionByName(self.spark.createDataFrame([row], SCHEMA)))

    def register(self, path: str, name: str = "", kg_id: str | None = None, now: float | None = None) -> dict:
        """Check, discover, configure and record a saved graph; ConnectionError if it cannot be read."""
        ok, why = graphs.check(self.spark, path)
        if not ok:
            raise ConnectionError(f"cannot read a graph at {path}: {why}")
        now = time.time() if now is None else now
        kg_id = kg_id or f"kg_{uuid.uuid4().hex[:12]}"
        document = schema.discover(graphs.load(self.spark, path))
        config = configuration.generate(self.spark, document)
        self.put((kg_id, name or path.rstrip("/").rsplit("/", 1)[-1], path, json.dumps(document), json.dumps(config), "active", now, now))
        by_strategy: dict[str, int] = {}
        for spec in config["intent_patterns"].values():
            by_strategy[spec["strategy"]] = by_strategy.get(spec["strategy"], 0) + 1
        return {"kg_id": kg_id, "name": name, "labels": document["node_labels"], "total_nodes": document["total_nodes"], "total_relationships": document["total_relationships"], "intents": len(config["intent_patterns"]), "strategies": by_strategy}

    def ensure_default(self, path: str, now: float | None = None) -> dict:
        self.open.pop(DEFAULT, None)
        return self.register(path, DEFAULT, DEFAULT, now)

    def get(self, kg_id: str) -> dict | None:
        r = self.table().where(F.col("kg_id") == kg_id).first()
        return r.asDict() if r else None

    def list_all(self) -> DataFrame:
        """Entries by last use, newest first, with the schema in figures."""
        s = F.from_json("schema_json", "total_nodes long, total_relationships long, node_labels array<string>")
        return self.table().select("kg_id", "name", "path", "status", "created_at", "last_used", s["total_nodes"].alias("total_nodes"), s["total_relationships"].alias("total_relationships"), F.size(s["node_labels"]).alias("n_labels")).orderBy(F.desc("last_used"), "kg_id")

    def delete(self, kg_id: str) -> bool:
        if self.get(kg_id) is None:
            return False
        self._write(self.table().where(F.col("kg_id") != kg_id))
        self.open.pop(kg_id, None)
        return True

    def touch(self, kg_id: str, now: float | None = None) -> None:
        r = self.get(kg_id)
        if r:
            self.put(tuple((r | {"last_used": time.time() if now is None else now}).values()))

    def pipeline(self, kg_id: str):
        """The graph's question pipeline, made once, with the stored schema and configuration; KeyError for an unknown id."""
        from ..plans.question import QuestionPipeline

        if kg_id not in self.open:
            r = self.get(kg_id)
            if r is None:
                raise KeyError(kg_id)
            document, config = json.loads(r["schema_json"]), json.loads(r["config_json"])
            self.open[kg_id] = QuestionPipeline(graphs.load(self.spark, r["path"], document["searchable_properties"]), config)
        self.touch(kg_id)
        return self.open[kg_id]

    def graph(self, kg_id: str):
        return self.pipeline(kg_id).graph

    def agent(self, kg_id: str, memory, model):
        """An agent on the graph; RuntimeError without a language model."""
        from ..plans.agent import Agent

        if model is None:
            raise RuntimeError("an agent needs a language model")
        pipeline = self.pipeline(kg_id)
        pipeline.model = model
        return Agent(pipeline, memory, model)
