"""SimHash near-duplicates found through a byte-position inverted index.

A fingerprint is eight bytes, each at its position. Two fingerprints that differ in at
most two bits differ in at most two bytes, so they share at least six of the eight
positional bytes: the count every linked pair is guaranteed to reach. Postings are kept
for sets of positional bytes instead of single ones, because a list for one byte holds
a 256th of the corpus. The eight positions form four couples, two of which must agree
wholly, so the six unions of two couples (four positional bytes, 32 bits) cover every
pair. Within a posting list the shared positional bytes of each pair are tallied, pairs
below six are dropped and the rest verified bit by bit. A list longer than ``cap`` is
indexed again under two more of its positions; six shared bytes leave two free, hence
at most 65,536 different fingerprints, however large the corpus.

Copies have one fingerprint and are folded before the index. A list reports a spanning
forest of its links, never all pairs.

Near-duplicates by similarity differ in more bits than two. For them ``near_fingerprints`` keeps
a list for each couple of positional bytes: six differing bits leave two bytes shared, and
of those that differ in more most still share two. Its pairs are candidates for an exact check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, map_batches, matching, prepare, private, quoted, spanning_forest, utf8, without
from ..operators.components import connected_components

SEED = 42
CAP = 1024
COUPLES = ((0, 1), (2, 3), (4, 5), (6, 7))
#: Sets of four positions: one of them is shared by any pair with at most two unequal bytes.
KEYS = [a + b for a, b in combinations(COUPLES, 2)]
#: Bits that candidates for an exact check may differ in, shared positional bytes they are tallied by, pairs that a list gives of one member.
WIDE_BITS, SHARED, NEAR = 12, 2, 2
_CHUNK = 1 << 15


def simhash(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a text: bit i is set if over half of the shingles' hashes set it."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, starts, ends, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest, ends = xxhash.xxh64_intdigest, ends[width - 1 :]
    counts, total = np.zeros(64, dtype=np.int64), len(ends)
    for i in range(0, total, _CHUNK):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=False)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def set_print(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes: bit i is set if over half of them set it."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp: the fingerprint as a signed long), one row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [signed(simhash(t, width)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return map_batches(dealt(docs.select(quoted(id_col).alias("id"), utf8(quoted(text_col)).alias("text"))), run, f"id {kind}, fp long")


def _bytes(positions) -> Column:
    """The positional bytes as one number, beneath them the positions themselves."""
    mask = sum(0xFF << (8 * p) for p in positions)
    mask -= (1 << 64) if mask >> 63 else 0
    return F.struct(F.lit(",".join(map(str, positions))).alias("at"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"))


def _index(fps: DataFrame, position_sets) -> DataFrame:
    return fps.select("fp", F.explode(F.array(*[_bytes(p) for p in position_sets])).alias("key")).select("fp", F.col("key.at").alias("at"), F.col("key.value").alias("value"))


def list_links(fps: np.ndarray, max_bits: int = 2, cap: int = CAP) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of a posting list."""
    least, pairs = 8 - max_bits, []
    if len(fps) <= cap:
        octets = fps.view(np.uint8).reshape(-1, 8)
        for i in range(0, len(fps), 128):
            tally = (octets[i : i + 128, None, :] == octets[None, :, :]).sum(axis=2)
            a, b = np.nonzero(tally >= least)
            a += i
            a, b = a[a < b], b[a < b]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            pairs += zip(fps[a[near]].tolist(), fps[b[near]].tolist(), strict=True)
    else:  # six shared bytes: probe for what lies within max_bits in the two others
        base = np.sort(fps)
        spread = int(np.bitwise_or.reduce(base ^ base[0]))
        free = [1 << i for i in range(64) if spread >> i & 1]
        masks = [sum(c) for n in range(1, max_bits + 1) for c in combinations(free, n)]
        for m in masks:
            other = base ^ np.uint64(m)
            at = np.minimum(np.searchsorted(base, other), len(base) - 1)
            hit = (base[at] == other) & (base < other)
            if hit.any():
                pairs += spanning_forest(zip(base[hit].tolist(), other[hit].tolist(), strict=True))
        pairs = spanning_forest(pairs)
    return spanning_forest(pairs)


def _postings(index: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """Links (a, b) found in the lists of ``index`` that ``sizes`` names."""
    lists = index.join(sizes.select("at", "value"), ["at", "value"]).groupBy("at", "value").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, a, b = batch.column(0), [], []
        values, offsets = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.offsets) - column.offsets[0].as_py()
        for i in range(len(column)):
            for x, y in list_links(values[offsets[i] : offsets[i + 1]], cap=cap):
                a.append(signed(x))
                b.append(signed(y))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(lists, run, "a long, b long")


def fingerprint_links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at two or fewer differing bits, enough of them to connect all that are connected."""
    index = _index(fps, KEYS)
    sizes = checkpoint(index.groupBy("at", "value").count().where("count > 1"))
    links = _postings(index, sizes.where(F.col("count") <= cap), cap)
    hot = sizes.where(F.col("count") > cap)
    if not hot.isEmpty():
        for four in KEYS:
            rest = [p for p in range(8) if p not in four]
            members = _index(fps, [four]).join(hot.select("at", "value"), ["at", "value"], "left_semi").select("fp")
            finer = _index(members.distinct(), [four + extra for extra in combinations(rest, 2)])
            links = links.union(_postings(finer, finer.groupBy("at", "value").count().where("count > 1"), cap))
    return links.distinct()


def list_pairs(lists: np.ndarray, fps: np.ndarray, fresh: int = 0, max_bits: int = WIDE_BITS, cap: int = CAP, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint from place ``fresh`` on the nearest ``near`` before it in its list, of at most ``cap``, within ``max_bits``; both arrays sorted by list and fingerprint."""
    at, made, bits, a, b = np.arange(fresh, len(fps)), np.zeros(len(fps), dtype=np.int64), fps.view(np.uint64), [fps[:0]], [fps[:0]]
    for back in range(1, cap):
        at = at[at >= back]
        at = at[(lists[at] == lists[at - back]) & (made[at] < near)]
        if not len(at):
            break
        hit = at[np.bitwise_count(bits[at] ^ bits[at - back]) <= max_bits]
        made[hit] += 1
        a.append(fps[hit - back])
        b.append(fps[hit])
    return np.concatenate(a), np.concatenate(b)


def near_fingerprints(fps: DataFrame, max_bits: int = WIDE_BITS, cap: int = CAP, near: int = NEAR) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` that share two positional bytes and differ in ``max_bits`` or fewer.

    Any two that differ in six bits or fewer share two bytes and meet in a list. A list
    gives no more than ``near`` pairs of each member, so a dense group costs no square: what
    is to be whole needs a way for the pairs not given.
    """
    prepare(fps.sparkSession)
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 16) + byte(p) * 256 + byte(q) for i, (p, q) in enumerate(combinations(range(8), SHARED))]
    index = fps.select(F.explode(F.array(*keys)).alias("list"), "fp").repartition("list").sortWithinPartitions("list", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = held = np.empty(0, dtype=np.int64)
        for batch in batches:
            fresh = len(held)
            lists, held = np.concatenate([lists, np.asarray(batch.column(0))]), np.concatenate([held, np.asarray(batch.column(1))])
            a, b = list_pairs(lists, held, fresh, max_bits, cap, near)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            if len(lists):
                tail = max(int(np.searchsorted(lists, lists[-1])), len(lists) - cap + 1)
                lists, held = lists[tail:], held[tail:]

    return index.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = CAP) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest id
    reached through links of at most two differing bits, itself included.

    Null and empty texts, and those of white space, have no words: fingerprint zero,
    linked like any other. Repeated rows stay, one row out for each row in. A null id is
    no candidate for ``component_id``, which is null only where all its component's ids
    are. An empty table gives an empty result; texts of any length are read whole.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, width))
    reps = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(fingerprint_links(reps.select("fp"), cap)).withColumnRenamed("node", "fp")
    linked = reps.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    found = reps.join(linked.join(least, "root").select("fp", "component"), "fp", "left").select("fp", F.when(F.col("component").isNull() | (F.col("rep") < F.col("component")), F.col("rep")).otherwise(F.col("component")).alias("component"))
    found = checkpoint(found)  # dealt anew like the prints, so that Spark can split a fingerprint that very many rows have
    return prints.join(found, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group of near-duplicates, chosen as ``one_of_each`` does."""
    return one_of_each(docs, lambda keyed: near_duplicates(keyed, "key", "text", width, cap), id_col, text_col)


def one_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group that ``find`` gives for (key, text) as (key, component_id).

    The row with the smallest id stays (null before all others), of equal ids that with the
    lower MD5 of its text, of rows equal in both any one. What meets the texts is what goes:
    as few as ``FEW`` rows are broadcast, so that no text is shuffled.
    """
    mark = F.md5(utf8(docs[f"`{text_col}`"]))
    keyed = docs.select(F.struct(docs[f"`{id_col}`"].alias("id"), mark.alias("mark")).alias("key"), docs[f"`{text_col}`"].alias("text"))
    key = [F.xxhash64("key.id").alias("h"), F.col("key.mark").alias("mark")]
    found = checkpoint(find(keyed).select(*key, (F.col("key") == F.col("component_id")).alias("stays")).groupBy("h", "mark", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"))
    kept = without(docs, found.where("not stays or n > 1").select("h", "mark"), id_col, text_col)
    repeated = found.where("stays and n > 1").select("h", "mark")
    if repeated.isEmpty():
        return kept
    once = private("__once", docs)
    again = matching(docs, repeated, id_col, text_col).withColumn(once, mark)
    return kept.unionAll(again.dropDuplicates([id_col, once]).drop(once))
