"""Removal of lines that many documents share.

Lines are exploded into normalised keys, hashed and counted once a document; the hashes
found in enough documents go back to the documents, where the remaining lines are joined
again in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, map_batches, private, quoted, utf8

WHITE = b" \t\n\v\f\r"
#: Frequent digests of 16 bytes, some 100 in a set, that are broadcast; beyond that texts are joined with theirs.
FEW = 200_000


def line_key(line: bytes) -> bytes:
    """What lines are compared by: no ASCII white space at either end, A-Z as a-z."""
    return line.strip(WHITE).lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def key_hashes(text: bytes, min_chars: int = 1) -> set[bytes]:
    """Digests of the distinct keys of ``min_chars`` code points or more."""
    keys = {line_key(x) for x in text.split(b"\n")}
    return {_digest(k) for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode(errors="replace")) >= min_chars)}


def drop_lines(text: bytes, dropped: set[bytes]) -> tuple[int, bytes, int]:
    """Lines before, the text that stays, lines dropped."""
    lines = text.split(b"\n")
    stay = [x for x in lines if _digest(line_key(x)) not in dropped] if dropped else lines
    return len(lines), b"\n".join(stay), len(lines) - len(stay)


def _hashes(docs: DataFrame, text_col: str, min_chars: int, named: bool, id_col: str | None = None) -> DataFrame:
    """A row for each distinct key of each row of ``docs``: its ``hash``, and if ``named`` the row's (h, mark)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(key_hashes(t, min_chars)) for t in batch.column(0).to_pylist()]
        hashes = pa.array([h for x in found for h in x], pa.binary())
        rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), hashes], names=[*batch.schema.names[1:], "hash"])

    text = utf8(quoted(text_col)).alias("text")
    if not named:
        return map_batches(dealt(docs.select(text)), run, "hash binary")
    return map_batches(docs.select(text, F.xxhash64(quoted(id_col)).alias("h"), F.md5(utf8(quoted(text_col))).alias("mark")), run, "h long, mark string, hash binary")


def _without_frequent(docs: DataFrame, columns: list[Column], id_col: str, text_col: str, min_docs: int, min_chars: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[set[bytes]]]]:
    """``columns`` of ``docs`` and its text as bytes, and what tells, for a batch of them, the digests to drop from each row.

    Up to ``FEW`` frequent digests are broadcast and each row drops its own of them; texts
    stay where they are. Beyond that the digests go back to the rows that hold them, rows of
    one id and text being one, and texts are joined with them.
    """
    often = checkpoint(_hashes(docs, text_col, min_chars, False).groupBy("hash").count().where(F.col("count") >= min_docs).select("hash"))
    text = utf8(docs[f"`{text_col}`"]).alias(private("__text", docs))
    if often.count() <= FEW:
        every = docs.sparkSession.sparkContext.broadcast({bytes(r.hash) for r in often.collect()})
        return dealt(docs.select(*columns, text)), lambda batch: [every.value] * batch.num_rows
    held = _hashes(docs, text_col, min_chars, True, id_col)  # dealt anew, so that Spark can split a line that very many rows hold
    own = held.join(often, "hash").groupBy("h", "mark").agg(F.collect_set("hash").alias("hashes"))
    joined = docs.join(own, (F.xxhash64(docs[f"`{id_col}`"]) == own["h"]) & (F.md5(utf8(docs[f"`{text_col}`"])) == own["mark"]), "left")
    return joined.select(*columns, text, own["hashes"].alias(private("__hashes", docs))), lambda batch: [set(h or ()) for h in batch.column(batch.num_columns - 1).to_pylist()]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept_sha256) for each row of ``docs``.

    A null or empty text is one empty line. Each row counts as one document, repeated rows
    and null ids too; a line that one document repeats counts once. Keys shorter than
    ``min_chars`` code points are never dropped. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source, dropped = _without_frequent(docs, [docs[f"`{id_col}`"].alias("id")], id_col, text_col, min_docs, min_chars)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [drop_lines(t, h) for t, h in zip(batch.column(1).to_pylist(), dropped(batch), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out], pa.string())], names=["id", "n_lines", "n_dropped", "kept_sha256"]
        )

    return map_batches(source, run, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs``, same columns and rows, without the lines that ``min_docs`` rows share.

    ``size_col``, if the table has it, is set to the new text's code points where the text
    changed. Null texts stay null; other cases are as in ``line_report``.
    """
    names, types = docs.columns, docs.schema
    at, size = names.index(text_col), names.index(size_col) if size_col in names else -1
    source, dropped = _without_frequent(docs, [docs[f"`{c}`"] for c in names], id_col, text_col, min_docs, min_chars)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns[: len(names)])
        texts, sizes = columns[at].to_pylist(), columns[size].to_pylist() if size >= 0 else []
        for i, (text, hashes) in enumerate(zip(batch.column(len(names)).to_pylist(), dropped(batch), strict=True)):
            if hashes and texts[i] is not None:
                _, kept, n = drop_lines(text, hashes)
                if n:
                    texts[i] = kept.decode(errors="replace")
                    if size >= 0:
                        sizes[i] = len(texts[i])
        columns[at] = pa.array(texts, columns[at].type)
        if size >= 0:
            columns[size] = pa.array(sizes, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(source, run, types)


ORACLE = r"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), lines as (
    select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from docs
), keyed as (
    select r, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from lines
), often as (
    select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10
), marked as (
    select keyed.*, often.k is not null as drop_it from keyed left join often using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (drop_it) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not drop_it), '')) as kept_sha256
from marked group by r, doc_id
"""
