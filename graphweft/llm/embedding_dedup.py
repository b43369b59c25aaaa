"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one, where a cosine of at least ``threshold`` is an angle of
at most theta. Pivots, far apart from each other, partition them: each vector's home is the
cell of its nearest pivot. By the triangle inequality a neighbour of a vector v can have its
home in cell j only if v lies within theta of the plane midway between its own pivot and
pivot j, and within theta of the farthest member of cell j; v is replicated to those cells,
of lower number than its own, and to no others. So every pair within theta meets in exactly
one cell, and cells join independently, in blocks of bounded size.

Copies of one vector are folded before the join. A block reports, for each vector, how many
others it links to and a link towards the smallest of its component, never all pairs. How
much the pivots prune depends on the data: vectors in clusters prune well; directions
spread evenly over many dimensions are all near every midway plane, and then cells are
replicated to most others and the join compares all blocks, as any exact method must.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, prepare, quoted, spanning_forest
from ..operators.components import connected_components

#: Vectors a cell aims at; rows of a block; vectors the pivots are chosen from; pivots at most.
CELL, BLOCK, SAMPLE, MAX_PIVOTS = 2_048, 2_048, 8_192, 1_024
SAMPLE_NUMBERS = 1 << 21  # components of those vectors, all together: what the driver holds of them
_SLACK = 1e-9  # on bounds only: rounding may bring a vector to a cell too many, never too few


def units(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and the vectors, in double precision and of length one.

    Unusable are null vectors, those with null or non-finite components and those of no
    length. All vectors that are usable have the first one's number of components.
    """
    sizes = np.asarray(arrays.value_lengths().fill_null(0), dtype=np.int64)
    whole, flat = sizes > 0, arrays.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole[owner[np.asarray(flat.is_null())]] = False
        flat = flat.fill_null(0)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = int(sizes[whole.argmax()])
    starts, values = np.cumsum(sizes) - sizes, np.asarray(flat, dtype=np.float64)
    rows = np.nonzero(whole & (sizes == dim))[0]
    x = values[starts[rows][:, None] + np.arange(dim)[None, :]]
    top = np.abs(x).max(axis=1)
    good = np.isfinite(top) & (top > 0)
    rows, x = rows[good], x[good] / top[good][:, None]
    return rows, x / np.sqrt((x * x).sum(axis=1))[:, None]


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, each the farthest from those before it."""
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-12:
            break
        picked.append(at)
        np.maximum(nearest, sample @ sample[at], out=nearest)
    return sample[picked]


class Cells:
    """Homes of vectors and the lower cells they must visit."""

    def __init__(self, pivots: np.ndarray, threshold: float, radii: np.ndarray | None = None):
        self.pivots, self.sin = pivots, math.sqrt(max(0.0, 1 - threshold * threshold)) + _SLACK
        gaps = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))
        np.fill_diagonal(gaps, 1)
        self.gaps, self.theta, self.radii = gaps, math.acos(threshold) + 1e-6, radii

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its angle to that cell's pivot."""
        dots = x @ self.pivots.T
        home = dots.argmax(axis=1)
        return home, np.arccos(np.clip(dots[np.arange(len(x)), home], -1, 1))

    def visits(self, x: np.ndarray) -> np.ndarray:
        """For each row the cells, as booleans, in which it is compared: its own and lower ones within reach."""
        dots = x @ self.pivots.T
        home = dots.argmax(axis=1)
        best = dots[np.arange(len(x)), home]
        near = (best[:, None] - dots) <= self.sin * self.gaps[home]
        near &= np.arange(len(self.pivots))[None, :] < home[:, None]
        if self.radii is not None:
            near &= np.arccos(np.clip(dots, -1, 1)) <= self.radii[None, :] + self.theta
        near[np.arange(len(x)), home] = True
        return near


def block_links(ids: np.ndarray, x: np.ndarray, weights: np.ndarray, first: np.ndarray, second: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links among the rows ``first``, or between them and the rows ``second``.

    Returns, for each row, the summed weights of those it links to, and a spanning forest.
    """
    counts, pairs = np.zeros(len(ids), dtype=np.int64), []
    right = first if second is None else second
    for i in range(0, len(first), 512):
        a = first[i : i + 512]
        for j in range(i if second is None else 0, len(right), 4096):
            b = right[j : j + 4096]
            p, q = np.nonzero(x[a] @ x[b].T >= threshold)
            if second is None:
                keep = p + i < q + j
                p, q = p[keep], q[keep]
            p, q = a[p], b[q]
            if len(p):
                counts += np.bincount(p, weights[q], len(ids)).astype(np.int64) + np.bincount(q, weights[p], len(ids)).astype(np.int64)
                pairs += _forest(ids[p], ids[q])
    return counts, spanning_forest(pairs)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest; rounds of smallest neighbours first thin out the dense case."""
    if len(a) < 4096:
        return spanning_forest(zip(a.tolist(), b.tolist(), strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(label.tolist()) if r != i]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``vectors``; ids are long.

    Links are pairs of ids with a cosine of at least ``threshold``, computed in double
    precision. Vectors that are null, zero or empty or hold null or non-finite components
    link with nothing, and those of different lengths not with each other. A null id links
    with nothing, has a null component and isn't kept. Rows that repeat a vector under
    another id are linked; of rows that repeat an id one vector counts, the smallest, and
    each row gets its result. An empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are widened where they are compared, not where they are moved
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast(kind).alias("v"))
    own = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    good = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    usable = own.where(good)
    folded = checkpoint(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = checkpoint(_join(folded, threshold, cell, block, sample, max_pivots))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("linked").alias("linked"))
    reps = folded.join(roots, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("of"), "left")
    reps = reps.select(F.col("v").alias("w"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = usable.join(reps, F.col("v") == F.col("w")).select(F.col("id").alias("known"), "n_links", "component_id")
    out, component = rows.select("id").join(linked, F.col("id") == F.col("known"), "left"), F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _join(folded: DataFrame, threshold: float, cell: int, block: int, sample: int, max_pivots: int) -> DataFrame:
    """Links (a, b), enough to connect all that is connected, and with b null the rows ``linked`` to a."""
    sizes = folded.groupBy(F.size("v").alias("d")).count().collect()  # one row per number of components
    out = folded.sparkSession.createDataFrame([], "a long, b long, linked long")
    for r in sizes:
        out = out.union(_join_dim(folded.where(F.size("v") == r.d), r["count"], r.d, threshold, cell, block, sample, max_pivots))
    return out


def _join_dim(part: DataFrame, n: int, d: int, threshold: float, cell: int, block: int, sample: int, max_pivots: int) -> DataFrame:
    spark = part.sparkSession
    sample = max(max_pivots, min(sample, SAMPLE_NUMBERS // d))
    drawn = part if n <= sample else part.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    vectors = [r.v for r in drawn.select("v").orderBy("rep").collect()] or [part.first().v]
    pivots = choose_pivots(units(pa.array(vectors, pa.list_(pa.float64())))[1], min(max_pivots, max(1, math.ceil(n / cell))))
    k = len(pivots)
    plain = spark.sparkContext.broadcast(Cells(pivots, threshold))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, angle = plain.value.homes(units(batch.column(0))[1])
        return pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(angle, pa.float64())], names=["home", "angle"])

    radii = np.full(k, -10.0)  # of a cell without members: no one visits
    for r in map_batches(part.select("v"), measure, "home int, angle double").groupBy("home").agg(F.max("angle").alias("radius")).collect():
        radii[r.home] = r.radius + 1e-6
    cells = spark.sparkContext.broadcast(Cells(pivots, threshold, radii))

    def visits(batch: pa.RecordBatch) -> pa.RecordBatch:
        where, x = cells.value, units(batch.column(0))[1]
        homes, guests = np.bincount(where.homes(x)[0], minlength=k), np.zeros(k, np.int64)
        for i in range(0, len(x), 1024):
            guests += where.visits(x[i : i + 1024]).sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(homes, pa.int64()), pa.array(guests - homes, pa.int64())], names=["cell", "homes", "guests"])

    nh, ng = np.ones(k, np.int64), np.zeros(k, np.int64)
    for r in map_batches(part.select("v"), visits, "cell int, homes long, guests long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests")).collect():
        nh[r.cell], ng[r.cell] = max(1, -(-r.homes // block)), -(-r.guests // (4 * block))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Each vector to every task that compares it: a couple of blocks of one cell, homes before guests."""
        where, x = cells.value, units(batch.column(2))[1]
        reps = batch.column(0).to_numpy(zero_copy_only=False)
        mixed = (reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        home, step = where.homes(x)[0], max(8, 16384 // k)
        for i in range(0, len(x), step):
            row, c = np.nonzero(where.visits(x[i : i + step]))
            row += i
            is_home = c == home[row]
            mine = np.where(is_home, mixed[row] % nh[c], nh[c] + mixed[row] % np.maximum(ng[c], 1))
            times = nh[c] + np.where(is_home, ng[c], 0)
            at = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            mine, row, c = mine[at], row[at], c[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(np.minimum(mine, other), pa.int32()), pa.array(np.maximum(mine, other), pa.int32()), pa.array(mine > other), *(col.take(pa.array(row)) for col in batch.columns)],
                names=["cell", "low", "high", "second", "rep", "n", "v"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from place(batch)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, weights = (table.column(c).to_numpy() for c in ("rep", "n"))
        x, second = units(table.column("v").combine_chunks())[1], table.column("second").to_numpy(zero_copy_only=False)
        twofold = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        counts, forest = block_links(ids, x, weights, np.nonzero(~second)[0], np.nonzero(second)[0] if twofold else None, threshold)
        some = np.nonzero(counts)[0]
        a = np.concatenate([ids[some], np.array([f[0] for f in forest], np.int64)])
        b = pa.array([None] * len(some) + [f[1] for f in forest], pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "linked": pa.array(np.concatenate([counts[some], np.zeros(len(forest), np.int64)]), pa.int64())})

    placed = part.select("rep", "n", "v").mapInArrow(run, f"cell int, low int, high int, second boolean, rep long, n long, v {part.schema["v"].dataType.simpleString()}")
    return placed.groupBy("cell", "low", "high").applyInArrow(compare, "a long, b long, linked long")


ORACLE = """
with recursive usable as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
    select vec_id as node, vec_id as root from embeddings union select links.b, reach.root from reach join links on links.a = reach.node
), counted as (
    select a, count(*) as n from links group by 1
), components as (
    select node, min(root) as component_id from reach group by 1
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join components on node = vec_id left join counted on a = vec_id
"""
