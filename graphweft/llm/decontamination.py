"""Benchmark decontamination by winnowing.

Both sides hash every run of ``k`` words and keep, of each ``window - k + 1`` consecutive
hashes, the least. Equal spans keep equal hashes, so any shared span of ``window`` words
shares a fingerprint: none is missed. Document fingerprints that the benchmark has too are
extended to the windows around them, and those windows are joined, by a digest of their
words, with the benchmark's own; what joins is exact.

The benchmark's fingerprints meet the documents as a bitmap of 2 to 32 megabytes, by the
benchmark's size: it lets some strangers through, which the join then drops, and never
holds back a fingerprint of the benchmark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, map_batches, prepare, quoted, utf8, without

WINDOW, K = 10, 5
#: Address bits of the bitmap, least and most, and bytes of the pieces it is made in.
BITS, MAX_BITS, _PIECE = 24, 28, 1 << 16
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after A-Z became a-z


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, in order."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(k):
        h = (h ^ each[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash, the last among equals, of each ``width`` consecutive ones."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], width)[::-1]
    at = np.arange(len(view)) + width - 1 - view.argmin(axis=1)
    return at[np.r_[True, at[1:] != at[:-1]]]


def window_digest(words: list[bytes], start: int, length: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start : start + length]))


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of an item's windows: all of ``window`` words, or the whole shorter item."""
    if not words:
        return []
    return [(0, len(words))] if len(words) < window else [(i, window) for i in range(len(words) - window + 1)]


def item_fingerprints(words: list[bytes], window: int = WINDOW, k: int = K) -> np.ndarray:
    """The winnowed hashes of an item; a shorter item has the one hash of all its words."""
    if len(words) < window:
        return gram_hashes(words, len(words)) if words else np.zeros(0, np.uint64)
    h = gram_hashes(words, k)
    return h[winnow(h, window - k + 1)]


class Candidates:
    """Finds the windows of a text that hold a fingerprint in the bitmap."""

    def __init__(self, bitmap: np.ndarray, short: list[int], window: int, k: int, bits: int):
        self.bitmap, self.short, self.window, self.k, self.bits = bitmap, short, window, k, bits

    def known(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    def __call__(self, words: list[bytes]) -> list[tuple[int, int]]:
        h = gram_hashes(words, self.k)
        width = self.window - self.k + 1
        at = winnow(h, width)
        at = at[self.known(h[at])] if len(at) else at
        found = []
        if len(at):
            starts = (at[:, None] - np.arange(width)[None, :]).ravel()
            starts = np.unique(starts[(starts >= 0) & (starts <= len(words) - self.window)])
            found = [(s, self.window) for s in starts.tolist()]
        for n in self.short:
            if len(words) >= n:
                found += [(s, n) for s in np.nonzero(self.known(gram_hashes(words, n)))[0].tolist()]
        return found


def _length(digest: str) -> Column:
    """The words of a window, the first four bytes of its digest."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("int")


def bits_for(windows: int) -> int:
    """Address bits of a bitmap with some 32 bits a window, between the bounds."""
    return min(MAX_BITS, max(BITS, (32 * windows - 1).bit_length() if windows else 0))


def _bitmap(items: DataFrame, window: int, k: int, bits: int) -> np.ndarray:
    """The fingerprints' slots as bits; made in pieces of 64 KB, so the driver gets no row for each."""

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = np.concatenate([np.zeros(0, np.uint64), *(item_fingerprints(words_of(t), window, k) for t in batch.column(1).to_pylist())])
        return pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int64))], names=["slot"])

    def piece(table: pa.Table) -> pa.Table:
        own = np.zeros(_PIECE, np.uint8)
        slot = table.column("slot").to_numpy()
        np.bitwise_or.at(own, (slot >> 3) % _PIECE, (1 << (slot & 7)).astype(np.uint8))
        return pa.table({"at": pa.array([int(slot[0] >> 3) // _PIECE], pa.int64()), "octets": pa.array([own.tobytes()], pa.binary())})

    found = map_batches(items, slots, "slot long").distinct()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in found.groupBy(F.shiftright("slot", 3 + _PIECE.bit_length() - 1).alias("at")).applyInArrow(piece, "at long, octets binary").toLocalIterator():
        out[r["at"] * _PIECE : (r["at"] + 1) * _PIECE] = np.frombuffer(r["octets"], np.uint8)
    return out


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Each document's (row, id, n_words), and of the rows with hits (row, n_hit, items)."""
    prepare(docs.sparkSession)
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), utf8(quoted(item_text_col)).alias("text"))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, digests = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            found = {n.to_bytes(4) + window_digest(words, s, n) for s, n in item_windows(words, window)}
            names += [item] * len(found)
            digests += found
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.binary())], names=["item", "digest"])

    own = checkpoint(map_batches(items, windows, "item string, digest binary"))
    short = sorted(r.n for r in own.select(_length("digest").alias("n")).distinct().collect() if r.n < window)
    bits = bits_for(own.count())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items, window, k, bits))
    kind = docs.schema[id_col].dataType.simpleString()

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        find, sizes, starts, digests = Candidates(shared.value, short, window, k, bits), [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            found = find(words)
            sizes.append(len(words))
            starts.append([s for s, _ in found])
            digests.append([n.to_bytes(4) + window_digest(words, s, n) for s, n in found])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))], names=["id", "n_words", "starts", "digests"])

    scanned = map_batches(dealt(docs.select(quoted(id_col).alias("id"), utf8(quoted(text_col)).alias("text"))), candidates, f"id {kind}, n_words long, starts array<int>, digests array<binary>")
    scanned = checkpoint(scanned.withColumn("row", F.monotonically_increasing_id()))
    probes = scanned.where(F.size("starts") > 0).select("row", F.explode(F.arrays_zip("starts", "digests")).alias("x")).select("row", F.col("x.starts").alias("start"), F.col("x.digests").alias("digest"))
    hits = probes.join(own, "digest").withColumn("length", _length("digest"))
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def cover(state: Column, s: Column) -> Column:
        """Intervals in order: what each adds to those before."""
        end = s["start"] + s["length"]
        return F.struct(F.greatest(state["upto"], end).alias("upto"), (state["n"] + F.greatest(end - F.greatest(s["start"], state["upto"]), F.lit(0))).alias("n"))

    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "length"))), none, cover, lambda s: s["n"])
    found = hits.groupBy("row").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return scanned.select("row", "id", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, contaminated) for each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window, ``items`` lists
    the ids, as text and sorted, of the items with such windows. Null and empty texts have
    no words and no hits; an item without words has no windows; an item of null id marks
    words but isn't listed. Repeated rows and items change nothing for the others. Empty
    tables are allowed on either side.
    """
    rows, found = _scan(docs, benchmark, id_col, text_col, item_col, item_text_col, window, k)
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``contamination`` with the items as a SHA-256 of their comma-joined ids."""
    found = contamination(docs, benchmark, **options)
    return found.select(found.columns[0], "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window.

    Rows are told apart by id and text, so one of two rows with the same id can go alone.
    """
    key = F.struct(F.xxhash64(docs[f"`{id_col}`"]).alias("h"), F.md5(utf8(docs[f"`{text_col}`"])).alias("mark"))
    keyed = docs.select(key.alias("key"), docs[f"`{text_col}`"].alias("text"))
    bad = contamination(keyed, benchmark, id_col="key", text_col="text", **options).where("contaminated").select("key.h", "key.mark").distinct()
    return without(docs, checkpoint(bad), id_col, text_col)


ORACLE = r"""
with doc_words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item_words as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_windows as (
    select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as window_text
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)
), lengths as (
    select distinct n from item_windows
), doc_windows as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as window_text
    from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from doc_words, lengths where len(w) >= n)
), hits as (
    select doc_id, d.n, i, item_id from doc_windows d join item_windows using (n, window_text)
), covered as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id
), named as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join covered using (doc_id) left join named using (doc_id)
"""
