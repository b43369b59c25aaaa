"""Secrets in texts, those in several parts included.

A credential often comes in parts: an access identifier, a secret and an endpoint. Some
parts are weak evidence alone: a user name, a random-looking word, a URL. Candidates of the
three roles are found in one pass; then, within each scope (a block of text without blank
lines), an interval join links parts that stand within ``reach`` code points of each other,
and a weak candidate is reported only if a complementary part co-occurs. The join sweeps
intervals in order of their starts, so its cost follows the number of parts, not of pairs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import dealt, map_batches, quoted
from .spans import joined, sha256

BASE = ("assign", "access", "hex")
ADDED = ("ident", "part", "endpoint")
KINDS = BASE + ADDED
REACH = 400

_HINTS = ("passw", "secret", "token", "api")
_either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_ASSIGN = re.compile("(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r")[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_NAMED = r"(?i)(?<![a-z0-9])(?:%s)[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?([A-Za-z0-9+/_.@~-]{%d,}+)"
_IDENT = re.compile(_NAMED % (r"access[_-]?key[_-]?id|access[_-]?id|client[_-]?id|account[_-]?(?:id|name)|key[_-]?id|user[_-]?(?:id|name)?|login|uid", 2))
_PART = re.compile(_NAMED % (r"access[_-]?key|client[_-]?key|private[_-]?key|auth[_-]?key|shared[_-]?key|account[_-]?key|signature|pwd|pass|key", 6))
_WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])")
_ENDPOINT = re.compile(r"(?i)(?<![a-z0-9])(?:[a-z][a-z0-9+.-]{1,15}+://[^\s\"'<>|]{3,}+|(?:host(?:name)?|endpoint|server|bucket|region|url)[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?[A-Za-z0-9][A-Za-z0-9./:_-]{2,}+)")
_COLON = re.compile("[:=]")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each base kind."""
    low = text.lower()
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(h in low for h in _HINTS) else [],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def random_looking(word: str) -> bool:
    """Mixed case and digits, and at least 3.6 bits a character."""
    if not (any(c.islower() for c in word) and any(c.isupper() for c in word) and any(c.isdigit() for c in word)):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.6


def _weak(text: str) -> list[tuple[str, int, int]]:
    """Candidates by role, those of one place once: a named part before a bare word."""
    found = [("part", *m.span()) for m in _PART.finditer(text)]
    found += [("ident", *m.span()) for m in _IDENT.finditer(text)]
    found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    found += [("part", *m.span()) for m in _WORD.finditer(text) if random_looking(m[0])]
    return found


class _Taken:
    """Disjoint spans, and whether another overlaps one of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        self.starts, self.ends = [m[0] for m in merged], [m[1] for m in merged]

    def overlap(self, s: int, e: int) -> bool:
        i = bisect_left(self.ends, s + 1)
        return i < len(self.starts) and self.starts[i] < e


def _near(spans: list[tuple[int, int]], s: int, e: int, reach: int) -> bool:
    """Whether one of the spans, in order and disjoint, is within reach of s to e."""
    i = bisect_left(spans, s - reach, key=lambda x: x[1])
    return i < len(spans) and spans[i][0] <= e + reach


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def linked(text: str, base: dict[str, list[tuple[int, int]]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """The weak candidates whose complement co-occurs in their scope.

    A secret part needs an identifier or endpoint, an identifier a secret, an endpoint a
    secret; base spans count as parts of their role, but two base spans report nothing new.
    """
    weak = _weak(text)
    if not weak:
        return []
    taken = _Taken([x for spans in base.values() for x in spans])
    weak = [w for w in weak if not taken.overlap(w[1], w[2])]
    roles = {"ident": list(base["access"]), "part": [*base["assign"], *base["hex"]], "endpoint": []}
    own: dict[str, list[tuple[int, int]]] = {r: [] for r in ADDED}
    held: list[tuple[int, int]] = []
    for role in ADDED:
        apart = _Taken(held)
        own[role] = [x for x in _disjoint([(s, e) for r, s, e in weak if r == role]) if not apart.overlap(*x)]
        held += own[role]
        roles[role] += own[role]
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scopes: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for role, spans in roles.items():
        for x in _disjoint(spans):
            scopes.setdefault(bisect_left(cuts, x[0]), {r: [] for r in ADDED})[role].append(x)
    needs = {"ident": ("part",), "part": ("ident", "endpoint"), "endpoint": ("part",)}
    out = []
    for role, spans in own.items():
        for s, e in spans:
            scope = scopes[bisect_left(cuts, s)]
            if any(_near(scope[other], s, e, reach) for other in needs[role]):
                out.append((role, s, e))
    return out


def find(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and linked weak ones, each by start, then kind, in code points."""
    base = base_spans(text)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted([(k, s, e) for k, spans in base.items() for s, e in spans], key=order), sorted(linked(text, base, reach), key=order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row.

    Counts and digest are of the base spans; ``spans`` holds them and the ``n_linked`` weak
    ones, ``kind:start:end`` in code points, by start, then kind. A null text is empty;
    repeated rows give equal rows; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, more = [[] for _ in BASE], [], [], []
        for text in batch.column(1).to_pylist():
            base, added = find(text or "", reach)
            for c, k in zip(counts, BASE, strict=True):
                c.append(sum(b[0] == k for b in base))
            digests.append(sha256(joined(base)))
            spans.append(joined(sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))))
            more.append(len(added))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_linked"])

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    return map_batches(dealt(source), run, f"id {kind}, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string, n_linked long").withColumnRenamed("id", id_col)
