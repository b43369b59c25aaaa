"""Property graphs as two DataFrames, and the ways in and out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import value_type
from .shared import checkpoint

NODE_SCHEMA = "id string, label string, name string, props string"
EDGE_SCHEMA = "source_id string, source_label string, rel_type string, rel_props string, target_id string, target_label string"
PROP_SCHEMA = "id string, label string, key string, value string, type string"


_EDGE = ["source_id", "source_label", "rel_type", "target_id", "target_label"]


def _flipped() -> list[Column]:
    return [F.col("target_id").alias("source_id"), F.col("target_label").alias("source_label"), F.col("rel_type"), F.col("source_id").alias("target_id"), F.col("source_label").alias("target_label")]


@dataclass(frozen=True)
class EdgePart:
    """The edges of one type in a table: two key columns, and how rows with equal ends fold."""

    rel_type: str
    source: str
    target: str
    rows: DataFrame  # (s, t)
    fold: str

    def edges(self, rows: DataFrame | None = None) -> DataFrame:
        t = (self.rows if rows is None else rows).where("s is not null and t is not null")
        t = t.distinct() if self.fold == "distinct" else t.groupBy("s").agg(F.min("t").alias("t")) if self.fold == "least" else t
        return t.select(_ident(self.source, "s").alias("source_id"), F.lit(self.source).alias("source_label"), F.lit(self.rel_type).alias("rel_type"), F.lit("{}").alias("rel_props"), _ident(self.target, "t").alias("target_id"), F.lit(self.target).alias("target_label"))

    def at(self, column: str, ids: list[str]) -> DataFrame | None:
        """The edges with an end among the ids; None if no id has that end's label and a key of its type."""
        end, label = ("s", self.source) if column == "source_id" else ("t", self.target)
        whole = self.rows.schema[end].dataType.typeName() in ("byte", "short", "integer", "long")
        keys = [i[len(label) + 1 :] for i in ids if i.startswith(label + ":")]
        if whole:
            keys = [int(k) for k in keys if k.lstrip("-").isascii() and k.lstrip("-").isdigit() and str(int(k)) == k]
        if not keys:
            return None
        held = F.col(end).isin(keys)
        if self.fold == "least" and end == "t":  # which target is least is told by all rows of a source
            return self.edges().where(F.col(column).isin([f"{label}:{k}" for k in keys]))
        return self.edges(self.rows.where(held))


def _ident(label: str, key: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, name, props JSON), edges with both labels beside the ids, and the properties one a row.

    Edges carry labels so that a hop filters them without a join; properties stay out of
    hops and are joined to the few edges that come out.
    """

    nodes: DataFrame
    edges: DataFrame
    properties: DataFrame
    searchable: dict[str, list[str]] = field(default_factory=dict)
    parts: tuple[EdgePart, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def labelled(self, labels: Iterable[str] = ()) -> DataFrame:
        """Nodes with one of the labels; all nodes if none is given."""
        labels = list(labels)
        return self.nodes.where(F.col("label").isin(labels)) if labels else self.nodes

    def edges_at(self, column: str, ids: list[str], rel_type: str = "") -> DataFrame:
        """Edges, of one type if named, whose ``column`` (source_id or target_id) is among a few ids, filtered where they are read.

        A view of tables skips the tables that hold no such end and filters the others' keys
        before it folds their rows; a saved graph filters the column.
        """
        if not self.parts:
            e = self.edges.where(F.col("rel_type") == rel_type) if rel_type else self.edges
            return e.where(F.col(column).isin(list(ids)))
        found = [e for part in self.parts if not rel_type or part.rel_type == rel_type if (e := part.at(column, ids)) is not None]
        return _union(found) if found else self.edges.limit(0)

    def either_way_at(self, ids: list[str], rel_type: str = "") -> DataFrame:
        """Edges from the ids in either direction, in the columns of ``either_way``, with the id as their source."""
        there, back = self.edges_at("source_id", ids, rel_type).select(*_EDGE), self.edges_at("target_id", ids, rel_type).where("source_id <> target_id")
        return there.unionAll(back.select(*_flipped()))

    def either_way(self) -> DataFrame:
        """Each edge in both orientations; a loop stands for both of its own."""
        e = self.edges.select(*_EDGE)
        return e.unionAll(e.where("source_id <> target_id").select(*_flipped()))

    def save(self, path: str) -> None:
        """Write the graph; labels and relationship types become partitions, edges are sorted by source."""
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.repartition("rel_type", F.pmod(F.xxhash64("source_id"), F.lit(64))).sortWithinPartitions("rel_type", "source_id").write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")
        self.properties.write.mode("overwrite").partitionBy("label", "key").parquet(f"{path}/properties")


def load(spark: SparkSession, path: str, searchable: dict[str, list[str]] | None = None) -> Graph:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Graph(read("nodes", NODE_SCHEMA), read("edges", EDGE_SCHEMA), read("properties", PROP_SCHEMA), searchable or {})


def check(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a saved graph can be read, and why not; never raises."""
    try:
        load(spark, path).edges.limit(1).count()
        return True, "ok"
    except Exception as error:  # a probe reports whatever went wrong
        return False, str(error).splitlines()[0]


def type_name(value_type_name: Column) -> Column:
    """The engine's name of an inferred type."""
    return F.when(value_type_name == "INTEGER", "Integer").when(value_type_name == "FLOAT", "Float").when(value_type_name == "BOOLEAN", "Boolean").when(value_type_name == "LIST", "List").when(value_type_name.isNull(), "Unknown").otherwise("String")


def build(spark: SparkSession, nodes: Iterable[tuple[str, str, dict]], relationships: Iterable[tuple[str, str, str]]) -> Graph:
    """Merge semantics for literals: see ``merge``."""
    rows = [(n, label, [str(k) for k in p], [str(v) for v in p.values()], [_py_type(v) for v in p.values()]) for n, label, p in nodes]
    frame = spark.createDataFrame(rows, "name string, label string, keys array<string>, values array<string>, types array<string>")
    return merge(frame, spark.createDataFrame(list(relationships), "source string, type string, target string"))


def _py_type(value) -> str:
    for kind, name in ((bool, "Boolean"), (int, "Integer"), (float, "Float"), (str, "String"), (list, "List")):
        if isinstance(value, kind):
            return name
    return "Unknown"


def merge(nodes: DataFrame, relationships: DataFrame) -> Graph:
    """Upsert: one node per (label, name), later rows' properties over earlier ones by name; edges join their ends by name over all labels, one per (source, type, target).

    Rows are in the order of a column ``ord`` of ``nodes``, or, without one, as they come.
    """
    n = nodes.withColumn("id", F.concat_ws(":", "label", "name"))
    if "ord" not in nodes.columns:
        n = checkpoint(n.withColumn("ord", F.monotonically_increasing_id()))
    cells = F.posexplode(F.arrays_zip("keys", "values", "types")).alias("i", "p")
    props = n.select("id", "label", "ord", cells).select("id", "label", F.col("p.keys").alias("key"), F.col("p.values").alias("value"), F.col("p.types").alias("type"), F.struct("ord", "i").alias("ord"))
    named = n.where("name is not null").select("id", "label", F.lit("name").alias("key"), F.col("name").alias("value"), F.lit("String").alias("type"), F.struct(F.col("ord"), F.lit(-1).alias("i")).alias("ord"))
    last = props.unionByName(named).groupBy("id", "label", "key").agg(F.max_by(F.struct("value", "type"), "ord").alias("v"))
    props = last.select("id", "label", "key", "v.value", "v.type")
    text = props.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("props"))
    one = n.select("id", "label", "name").dropDuplicates(["id"]).join(text, "id", "left").select("id", "label", "name", F.coalesce("props", F.lit("{}")).alias("props"))
    return Graph(one, resolve_by_name(one, relationships), props)


def resolve_by_name(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges from (source name, type, target name): every pair of nodes so named, once per type."""
    end = lambda x: nodes.where("name is not null").select(F.col("name").alias(x), F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"))
    joined = relationships.join(end("source"), "source").join(end("target"), "target")
    return joined.dropDuplicates(["source_id", "type", "target_id"]).select("source_id", "source_label", F.col("type").alias("rel_type"), F.lit("{}").alias("rel_props"), "target_id", "target_label")


#: The benchmark tables read as a graph: label, table, key, name, other properties with their types.
NODE_TABLES = (
    ("Region", "region", "r_regionkey", "r_name", ()),
    ("Nation", "nation", "n_nationkey", "n_name", ()),
    ("Customer", "customer", "c_custkey", "c_name", (("mktsegment", "c_mktsegment", "String"), ("acctbal", "c_acctbal", "Float"))),
    ("Supplier", "supplier", "s_suppkey", "s_name", (("acctbal", "s_acctbal", "Float"),)),
    ("Part", "part", "p_partkey", "p_name", (("brand", "p_brand", "String"), ("type", "p_type", "String"), ("size", "p_size", "Integer"), ("retailprice", "p_retailprice", "Float"))),
    ("Order", "orders", "o_orderkey", None, (("status", "o_orderstatus", "String"), ("priority", "o_orderpriority", "String"), ("totalprice", "o_totalprice", "Float"))),
)
#: Type, source label, its key, target label, its key, table, and how equal edges fold.
EDGE_TABLES = (
    ("IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey", "nation", "none"),
    ("LIVES_IN", "Customer", "c_custkey", "Nation", "c_nationkey", "customer", "none"),
    ("LOCATED_IN", "Supplier", "s_suppkey", "Nation", "s_nationkey", "supplier", "none"),
    ("PLACED", "Customer", "o_custkey", "Order", "o_orderkey", "orders", "none"),
    ("CONTAINS", "Order", "l_orderkey", "Part", "l_partkey", "lineitem", "distinct"),
    ("SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey", "lineitem", "distinct"),
    ("MADE_BY", "Part", "l_partkey", "Supplier", "l_suppkey", "lineitem", "least"),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph view of the benchmark tables; a query reads only the tables its labels and types need."""
    read = cache(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))  # a footer is read once per table, not per label and type
    nodes, props, parts = [], [], []
    for label, table, key, name, more in NODE_TABLES:
        t = read(table)
        shown = ((("name", name, "String"),) if name else ()) + more
        nodes.append(t.select(_ident(label, key).alias("id"), F.lit(label).alias("label"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"), F.to_json(F.struct(*[F.col(c).alias(p) for p, c, _ in shown])).alias("props")))
        cells = F.array(*[F.struct(F.lit(p).alias("key"), F.col(c).cast("string").alias("value"), F.lit(k).alias("type")) for p, c, k in shown])
        props.append(t.select(_ident(label, key).alias("id"), F.lit(label).alias("label"), F.explode(cells).alias("p")).select("id", "label", "p.key", "p.value", "p.type"))
    for kind, source, source_key, target, target_key, table, fold in EDGE_TABLES:
        parts.append(EdgePart(kind, source, target, read(table).select(F.col(source_key).alias("s"), F.col(target_key).alias("t")), fold))
    named = {label: ["name"] for label, _, _, name, _ in NODE_TABLES if name}
    return Graph(_union(nodes), _union([p.edges() for p in parts]), _union(props), named | {"Order": ["priority", "status"]}, tuple(parts))


def from_wide(nodes: DataFrame, label: str, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and properties of any table whose types aren't known: types are told by the values' look."""
    ident = F.concat(F.lit(label + ":"), F.col(key).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    props = nodes.select(ident.alias("id"), F.lit(label).alias("label"), F.explode(cells).alias("p")).select("id", "label", "p.key", "p.value", type_name(value_type(F.col("p.value"))).alias("type"))
    name = F.col("name").cast("string") if "name" in nodes.columns else F.lit(None).cast("string")
    return nodes.select(ident.alias("id"), F.lit(label).alias("label"), name.alias("name"), F.to_json(F.struct(*columns)).alias("props")), props
