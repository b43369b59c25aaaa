"""Traversal strategies: bounded joins from a small frontier.

Every strategy returns edge rows (source_id, source_label, rel_type, target_id,
target_label); ``with_names`` and ``with_properties`` join what else is wanted to the few
rows that come out. Limits keep a total order, so results do not depend on partitioning:
edges by (source, type, target), paths by length and then their nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.shared import Tables, checkpoint

EDGE = ["source_id", "source_label", "rel_type", "target_id", "target_label"]
EDGE_KEY = ["source_id", "rel_type", "target_id"]
# Rows or paths each strategy returns at most, and its default bounds.
TARGETED_ROWS, CHAINED_PATHS, VARIABLE_PATHS, SHORTEST_PATHS, GENERAL_ROWS = 50, 100, 60, 20, 30
MIN_HOPS, MAX_HOPS, SHORTEST_HOPS, MIN_CONNECTIONS = 1, 2, 6, 2
_FEW, FRONTIER_ROWS = 100, 100_000


@dataclass(frozen=True)
class Hop:
    relationship: str
    target_label: str = ""


@dataclass(frozen=True)
class Pattern:
    """An intent's traversal; which fields count depends on ``strategy``."""

    strategy: str = "targeted"
    keywords: tuple[str, ...] = ()
    relationship: str = ""
    source_label: str = ""
    target_label: str = ""
    entry_anchor: str = "source"
    entry_label: str = ""
    hops: tuple[Hop, ...] = ()
    min_hops: int = MIN_HOPS
    max_hops: int | None = None
    min_connections: int = MIN_CONNECTIONS
    description: str = ""

    @classmethod
    def of(cls, spec: dict) -> Pattern:
        known = {k: v for k, v in spec.items() if k in cls.__dataclass_fields__}
        p = cls(**known | {"keywords": tuple(spec.get("keywords", ()))})
        return replace(p, hops=tuple(Hop(h["relationship"], h.get("target_label", "")) for h in spec.get("hops", ())))


@dataclass(frozen=True)
class Subgraph:
    """Edges in order (``ord``), nodes in order of first appearance, entries first; hop_depth is the strategy's bound, not what was reached."""

    nodes: DataFrame
    edges: DataFrame
    strategy: str = "none"
    hop_depth: int = 0


def frontier(graph: Graph, ids: list[str]) -> DataFrame:
    return graph.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def anchored(graph: Graph, column: str, ids: list[str], rel_type: str = "") -> DataFrame:
    """Edges whose ``column`` is among the ids: filtered where they are read for few of them, else a semi-join with them broadcast (they are a literal list of the driver's)."""
    if len(ids) <= _FEW:
        return graph.edges_at(column, ids, rel_type).select(*EDGE)
    edges = (graph.edges.where(F.col("rel_type") == rel_type) if rel_type else graph.edges).select(*EDGE)
    at = graph.spark.createDataFrame([(i,) for i in ids], "anchor string")
    return edges.join(F.broadcast(at), F.col(column) == F.col("anchor"), "left_semi")


def either_anchored(graph: Graph, ids: list[str]) -> DataFrame:
    """Edges from the ids in either direction."""
    if len(ids) <= _FEW:
        return graph.either_way_at(ids)
    at = graph.spark.createDataFrame([(i,) for i in ids], "anchor string")
    return graph.either_way().join(F.broadcast(at), F.col("source_id") == F.col("anchor"), "left_semi")


def ahead(graph: Graph, frontier: DataFrame, rel_type: str = "") -> tuple[DataFrame, DataFrame]:
    """The frontier (with ``at``), computed, and the edges to join to it: of a few ids only theirs, else all. Up to ``FRONTIER_ROWS`` it is broadcast, so that a hop doesn't shuffle the edges; beyond that it is a plain side of the join."""
    done = checkpoint(frontier)
    ids = [r["at"] for r in done.select("at").distinct().limit(_FEW + 1).collect()]
    if len(ids) <= _FEW:
        return F.broadcast(done) if done.count() <= FRONTIER_ROWS else done, graph.edges_at("source_id", ids, rel_type).select(*EDGE)
    edges = graph.edges.where(F.col("rel_type") == rel_type) if rel_type else graph.edges
    return F.broadcast(done) if done.count() <= FRONTIER_ROWS else done, edges.select(*EDGE)


def _labels(edges: DataFrame, source: str, target: str) -> DataFrame:
    if source:
        edges = edges.where(F.col("source_label") == source)
    return edges.where(F.col("target_label") == target) if target else edges


def _capped(edges: DataFrame, n: int | None) -> DataFrame:
    edges = edges.select(*EDGE)
    return edges if n is None else edges.orderBy(*EDGE_KEY).limit(n)


def targeted(graph: Graph, ids: list[str], relationship: str, source_label: str = "", target_label: str = "", anchor: str = "source", limit: int | None = TARGETED_ROWS) -> DataFrame:
    """One hop over one type. ``either`` takes edges in both orientations and keeps those with an entry at either end."""
    if anchor == "either":
        e = anchored(graph, "source_id", ids, relationship).unionByName(anchored(graph, "target_id", ids, relationship))
        e = e.unionAll(e.select(F.col("target_id").alias("source_id"), F.col("target_label").alias("source_label"), "rel_type", F.col("source_id").alias("target_id"), F.col("source_label").alias("target_label")))
    else:
        e = anchored(graph, "target_id" if anchor == "target" else "source_id", ids, relationship)
    found = _labels(e, source_label, target_label).dropDuplicates(EDGE_KEY)
    return _capped(found, limit)


def _edge_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in EDGE])


def unwind(paths: DataFrame) -> DataFrame:
    """The distinct edges of ``path`` arrays."""
    return paths.select(F.explode("path").alias("e")).select("e.*").dropDuplicates(EDGE_KEY)


def _ordered_paths(paths: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return paths
    return paths.orderBy(F.size("path"), F.transform("path", lambda e: e["source_id"]), F.element_at("path", -1)["target_id"], F.transform("path", lambda e: e["rel_type"])).limit(n)


def chained_paths(graph: Graph, ids: list[str], entry_label: str, hops: list[Hop]) -> DataFrame:
    """Whole paths over a fixed sequence of typed hops; nothing for those that end early."""
    paths = None
    for hop in hops:
        if paths is None:
            e = _labels(anchored(graph, "source_id", ids, hop.relationship), entry_label, hop.target_label)
            paths = e.select(F.array(_edge_struct()).alias("path"), F.col("target_id").alias("at"))
        else:
            near, e = ahead(graph, paths, hop.relationship)
            paths = near.join(_labels(e, "", hop.target_label), F.col("at") == F.col("source_id")).select(F.array_append("path", _edge_struct()).alias("path"), F.col("target_id").alias("at"))
    return paths.select("path")


def chained(graph: Graph, ids: list[str], entry_label: str, hops: list[Hop], limit: int | None = CHAINED_PATHS) -> DataFrame:
    return unwind(_ordered_paths(chained_paths(graph, ids, entry_label, hops), limit))


def _open_ended(paths: DataFrame) -> DataFrame:
    return paths.where(F.element_at("path", 1)["source_id"] != F.element_at("path", -1)["target_id"]).select("path")


def trails(graph: Graph, ids: list[str], min_hops: int = MIN_HOPS, max_hops: int = MAX_HOPS) -> DataFrame:
    """Directed trails: no edge twice, nodes as often as they come, the end not the start."""
    same = lambda x: (x["source_id"] == F.col("source_id")) & (x["rel_type"] == F.col("rel_type")) & (x["target_id"] == F.col("target_id"))
    level = anchored(graph, "source_id", ids).select(F.array(_edge_struct()).alias("path"))
    found = []
    for k in range(1, max_hops + 1):
        if k > 1:
            level, e = ahead(graph, level.withColumn("at", F.element_at("path", -1)["target_id"]))
            found[-1:] = [_open_ended(level)] if found else []
            level = level.join(e, F.col("at") == F.col("source_id")).where(~F.exists("path", same)).select(F.array_append("path", _edge_struct()).alias("path"))
        if k >= min_hops:
            found.append(_open_ended(level))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def variable_hop(graph: Graph, ids: list[str], min_hops: int = MIN_HOPS, max_hops: int = MAX_HOPS, limit: int | None = VARIABLE_PATHS) -> DataFrame:
    return unwind(_ordered_paths(trails(graph, ids, min_hops, max_hops), limit))


def entry_pairs(graph: Graph, ids: list[str]) -> DataFrame:
    """(a, b) with a < b for each couple of entries."""
    f = frontier(graph, ids)
    return f.select(F.col("id").alias("a")).join(f.select(F.col("id").alias("b")), F.col("a") < F.col("b"))


def shortest_paths(graph: Graph, ids: list[str], max_hops: int = SHORTEST_HOPS) -> DataFrame:
    """(a, b, path) for each couple of entries that an undirected path of up to ``max_hops`` edges joins.

    Of several shortest paths the one with the least sequence of node ids, then of types.
    The search goes level by level from every a at once: a level keeps one path per node
    newly reached and joins those with the edges; it ends when all couples are settled.
    Labels are looked up at the end, so what is carried is ids and types. Levels of a few
    nodes read their own edges; the first larger one writes all edges, ids and types in both
    directions, once for the levels after it.
    """
    short = lambda e: e.select(F.col("source_id").alias("u"), "rel_type", F.col("target_id").alias("v"))
    every, tables = None, Tables(graph.spark)
    pairs = checkpoint(entry_pairs(graph, ids))
    total = pairs.count()
    nodes, types = F.array("a").alias("nodes"), F.array().cast("array<string>").alias("types")
    level = pairs.select("a").distinct().select("a", F.col("a").alias("at"), nodes, types)
    near, seen, found = F.broadcast(level), level.select("a", "at"), None  # as many rows as entries
    for _ in range(max_hops if total else 0):
        ids = [r["at"] for r in level.select("at").distinct().limit(_FEW + 1).collect()]
        if len(ids) > _FEW and every is None:
            every = tables.write(short(graph.either_way()))
        both = every if len(ids) > _FEW else short(graph.either_way_at(ids))
        step = near.join(both, F.col("at") == F.col("u")).select("a", F.col("v").alias("at"), F.struct(F.array_append("nodes", F.col("v")).alias("nodes"), F.array_append("types", F.col("rel_type")).alias("types")).alias("p"))
        fresh = step.join(seen, ["a", "at"], "left_anti").groupBy("a", "at").agg(F.min("p").alias("p"))
        level = checkpoint(fresh.select("a", "at", "p.nodes", "p.types"))
        n = level.count()
        near = F.broadcast(level) if n <= FRONTIER_ROWS else level
        hit = level.join(F.broadcast(pairs.withColumnRenamed("b", "at")), ["a", "at"])
        found = hit if found is None else found.unionAll(hit)
        seen = seen.unionAll(level.select("a", "at"))
        if not n or found.count() == total:
            break
    if found is None:
        found = level.limit(0)
    return found.select("a", F.col("at").alias("b"), "nodes", "types")


def shortest_path(graph: Graph, ids: list[str], max_hops: int = SHORTEST_HOPS, limit: int | None = SHORTEST_PATHS) -> DataFrame:
    """Edges of the pairwise shortest paths, in walking direction; of one entry, its directed trails instead."""
    if len(set(ids)) < 2:
        return variable_hop(graph, ids, 1, max_hops)
    paths = shortest_paths(graph, ids, max_hops)
    if limit is not None:
        paths = paths.orderBy(F.size("nodes"), "nodes", "types").limit(limit)
    steps = paths.select("nodes", F.posexplode("types").alias("i", "rel_type"))
    e = steps.select(F.get("nodes", F.col("i")).alias("source_id"), "rel_type", F.get("nodes", F.col("i") + 1).alias("target_id")).distinct()
    label = lambda end: graph.nodes.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
    return label("source").join(label("target").join(F.broadcast(e), "target_id"), "source_id").select(*EDGE)


def shared_neighbor(graph: Graph, ids: list[str], min_connections: int = MIN_CONNECTIONS) -> DataFrame:
    """Edges from the entries to every node adjacent, in either direction, to enough of them."""
    need = min(min_connections, len(set(ids)))
    near = either_anchored(graph, ids).dropDuplicates(EDGE_KEY)
    shared = near.groupBy("target_id").agg(F.count_distinct("source_id").alias("n")).where(F.col("n") >= need)
    return near.join(shared.select("target_id"), "target_id", "left_semi").select(*EDGE)


def general(graph: Graph, ids: list[str], limit: int | None = GENERAL_ROWS) -> DataFrame:
    return _capped(anchored(graph, "source_id", ids).dropDuplicates(EDGE_KEY), limit)


def neighbors(graph: Graph, node_id: str, limit: int = 5) -> DataFrame:
    """Undirected neighbours (rel_type, id, label) of one node."""
    e = graph.either_way_at([node_id])
    return e.select("rel_type", F.col("target_id").alias("id"), F.col("target_label").alias("label")).distinct().orderBy("id", "rel_type").limit(limit)


def run_pattern(graph: Graph, ids: list[str], pattern: Pattern | None, node_limit: int = GENERAL_ROWS) -> tuple[DataFrame, str, int]:
    """Edge rows, the strategy's name and its hop bound. An unknown strategy runs as general under its own name."""
    p = pattern
    if p is None:
        return general(graph, ids, node_limit), "general", 1
    if p.strategy == "targeted":
        return targeted(graph, ids, p.relationship, p.source_label, p.target_label, p.entry_anchor), p.strategy, 1
    if p.strategy == "chained":
        return chained(graph, ids, p.entry_label, list(p.hops)), p.strategy, len(p.hops)
    if p.strategy == "variable_hop":
        most = p.max_hops or MAX_HOPS
        return variable_hop(graph, ids, p.min_hops, most), p.strategy, most
    if p.strategy == "shortest_path":
        most = p.max_hops or SHORTEST_HOPS
        return shortest_path(graph, ids, most), p.strategy, most
    if p.strategy == "shared_neighbor":
        return shared_neighbor(graph, ids, p.min_connections), p.strategy, 1
    return general(graph, ids, node_limit), p.strategy, 1


def ordered(edges: DataFrame) -> DataFrame:
    """The rows with ``ord`` from 0, by key. Strategies bound their rows; the shared neighbours of a hub are the most that is ranked here."""
    at = F.expr("cast(row_number() over (order by source_id, rel_type, target_id) as int) - 1")
    return edges.select(*EDGE, at.alias("ord"))


def subgraph_nodes(graph: Graph, edges: DataFrame, ids: list[str]) -> DataFrame:
    """(id, label, name, ord) of the entries, as given, and of the edges' ends by first appearance, source before target."""
    entries = graph.spark.createDataFrame([(i, n - len(ids)) for n, i in enumerate(ids)], "id string, ord int")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), (F.col("ord") * 2).alias("ord")), F.struct(F.col("target_id").alias("id"), (F.col("ord") * 2 + 1).alias("ord")))).alias("n")).select("n.id", "n.ord")
    first = entries.unionByName(ends).groupBy("id").agg(F.min("ord").alias("ord"))
    return first.join(graph.nodes.select("id", F.coalesce("label", F.lit("Unknown")).alias("label"), "name"), "id", "left").select("id", F.coalesce("label", F.lit("Unknown")).alias("label"), "name", "ord")


def traverse(graph: Graph, ids: list[str], patterns: dict[str, Pattern], intent: str, node_limit: int = GENERAL_ROWS) -> Subgraph:
    """The subgraph an intent finds from the entries; an unknown intent takes one general hop."""
    if not ids:
        none = graph.spark.createDataFrame([], "id string, label string, name string, ord int")
        return Subgraph(none, graph.spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE) + ", ord int"))
    rows, strategy, depth = run_pattern(graph, ids, patterns.get(intent), node_limit)
    edges = ordered(rows)
    return Subgraph(subgraph_nodes(graph, edges, ids), edges, strategy, depth)


def with_properties(graph: Graph, edges: DataFrame) -> DataFrame:
    """The eight columns of a full edge row; the edges are few and broadcast only if Spark finds them so."""
    props = lambda end: graph.nodes.select(F.col("id").alias(f"{end}_id"), F.col("props").alias(f"{end}_props"))
    rels = graph.edges.select(*EDGE_KEY, "rel_props")
    out = edges.join(rels, EDGE_KEY, "left").join(props("source"), "source_id", "left").join(props("target"), "target_id", "left")
    return out.select("source_id", "source_label", "source_props", "rel_type", "rel_props", "target_id", "target_label", "target_props")
