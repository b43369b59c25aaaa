"""The service's requests as methods with plain dictionaries in and out; a web server is someone else's."""

from __future__ import annotations

import json
from dataclasses import asdict

from ..operators.catalog import DEFAULT, Catalog
from ..operators.memory import Memory
from .agent import Agent
from .model import LanguageModel


class ServiceError(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Service:
    def __init__(self, catalog: Catalog, memory_path: str, model: LanguageModel | None = None):
        self.catalog, self.model = catalog, model
        self.memory = Memory(catalog.spark, memory_path, model.embed_text if model else None)

    def health(self) -> dict:
        return {"status": "healthy"}

    def connect(self, path: str, name: str = "") -> dict:
        try:
            return self.catalog.register(path, name) | {"memory_layer_initialized": self.model is not None}
        except ConnectionError as error:
            raise ServiceError(400, str(error)) from error

    def graphs(self) -> dict:
        return {"graphs": [r.asDict() for r in self.catalog.list_all().collect()]}

    def _entry(self, kg_id: str) -> dict:
        found = self.catalog.get(kg_id)
        if found is None:
            raise ServiceError(404, f"KG '{kg_id}' not found")
        return found

    def graph(self, kg_id: str) -> dict:
        r = self._entry(kg_id)
        return {"kg_id": kg_id, "name": r["name"], "status": r["status"], "schema": json.loads(r["schema_json"]), "intents": list(json.loads(r["config_json"])["intent_patterns"])}

    def schema(self, kg_id: str = DEFAULT) -> dict:
        return json.loads(self._entry(kg_id)["schema_json"])

    def delete(self, kg_id: str) -> dict:
        if kg_id == DEFAULT:
            raise ServiceError(400, "Cannot delete the default KG")
        self._entry(kg_id)
        self.catalog.delete(kg_id)
        return {"status": "deleted", "kg_id": kg_id}

    def _pipeline(self, kg_id: str):
        self._entry(kg_id)
        pipeline = self.catalog.pipeline(kg_id)
        pipeline.model = self.model
        return pipeline

    def query(self, query: str, kg_id: str = DEFAULT) -> dict:
        r = self._pipeline(kg_id).query(query).as_dict()
        return r | {"entities": r.pop("entry_nodes")}

    def agent_query(self, query: str, kg_id: str = DEFAULT) -> dict:
        if self.model is None:
            raise ServiceError(500, "the agent needs a language model")
        return asdict(Agent(self._pipeline(kg_id), self.memory, self.model).execute(query, kg_id))

    def recall(self, query: str, kg_id: str = DEFAULT, threshold: float = 0.85) -> dict:
        shown = lambda r: r | {"similarity": round(r["similarity"], 3), "age_seconds": round(r["age_seconds"], 1)}
        return {"results": [shown(r) for r in self.memory.recall(query, kg_id, threshold)]}

    def memory_stats(self, kg_id: str = DEFAULT) -> dict:
        s = self.memory.stats(kg_id)
        return {"total_memories": s["total"], "memories_last_hour": s["last_hour"], "domain": kg_id}
