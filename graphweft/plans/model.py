"""The language model as a port, and a deterministic stand-in that needs no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable
from typing import Protocol

GROUNDING = "Answer only from the facts given as context. If they do not hold the answer, say so."


class LanguageModel(Protocol):
    def generate_text(self, prompt: str) -> str: ...

    def embed_text(self, text: str) -> list[float]: ...


class Offline:
    """Embeds by hashing words; generates what it is told to, or fails."""

    def __init__(self, reply: Callable[[str], str] | None = None, dims: int = 64):
        self.reply, self.dims, self.calls = reply, dims, 0

    def generate_text(self, prompt: str) -> str:
        self.calls += 1
        if self.reply is None:
            raise RuntimeError("no language model is attached")
        return self.reply(prompt)

    def embed_text(self, text: str) -> list[float]:
        v = [0.0] * self.dims
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dims] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_text(t) for t in texts]


def answer(model: LanguageModel, question: str, context: str) -> str:
    return model.generate_text(f"{GROUNDING}\n\nContext:\n{context}\n\nQuestion: {question}")


def with_retries(call: Callable[[], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again after 2, 4, ... seconds while the model says it is overloaded."""
    for n in range(tries):
        try:
            return call()
        except Exception as error:
            if "429" not in str(error) or n == tries - 1:
                raise
            sleep(2.0 ** (n + 1))
    raise RuntimeError("no tries")
