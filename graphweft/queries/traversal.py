"""Traversals of the graph of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import traverse as t
from ..sources.graph import from_tables, resolve_by_name
from .registry import BOTH, EDGES, NODES, query

COLUMNS = "source_id, source_label, rel_type, target_id, target_label"
KEY = "source_id, rel_type, target_id"


@query(f"with {EDGES} select {COLUMNS} from edges where rel_type = 'PLACED' and source_id in ('Customer:1', 'Customer:4') order by {KEY} limit 50")
def targeted_source(spark, sf_dir):
    return t.targeted(from_tables(spark, sf_dir), ["Customer:1", "Customer:4"], "PLACED", "Customer", "Order", "source")


@query(f"with {EDGES} select {COLUMNS} from edges where rel_type = 'SUPPLIES' and target_id in ('Part:1', 'Part:2', 'Part:3')")
def targeted_target(spark, sf_dir):
    return t.targeted(from_tables(spark, sf_dir), ["Part:1", "Part:2", "Part:3"], "SUPPLIES", "Supplier", "Part", "target", None)


@query(f"with {EDGES}, {BOTH} select distinct {COLUMNS} from both_ways where rel_type = 'MADE_BY' and (source_id in ('Part:1', 'Supplier:2') or target_id in ('Part:1', 'Supplier:2'))")
def targeted_either(spark, sf_dir):
    return t.targeted(from_tables(spark, sf_dir), ["Part:1", "Supplier:2"], "MADE_BY", anchor="either", limit=None)


@query(f"with {EDGES}, {BOTH} select distinct {COLUMNS} from both_ways where rel_type = 'MADE_BY' and (source_id in ('Part:1', 'Supplier:2') or target_id in ('Part:1', 'Supplier:2')) order by {KEY} limit 50")
def targeted_either_limited(spark, sf_dir):
    return t.targeted(from_tables(spark, sf_dir), ["Part:1", "Supplier:2"], "MADE_BY", anchor="either")


@query(f"with {EDGES} select {COLUMNS} from edges where source_id in ('Supplier:1', 'Customer:7') order by {KEY} limit 30")
def general_1hop(spark, sf_dir):
    return t.general(from_tables(spark, sf_dir), ["Supplier:1", "Customer:7"])


@query(f"with {EDGES}, {BOTH} select distinct rel_type, target_id as id, target_label as label from both_ways where source_id = 'Nation:3' order by id, rel_type limit 5")
def neighbors_undirected(spark, sf_dir):
    return t.neighbors(from_tables(spark, sf_dir), "Nation:3")


_CHAIN2 = f"with {EDGES}, paths as (select a.source_id as n0, a.target_id as n1, b.target_id as n2 from edges a join edges b on a.target_id = b.source_id where a.rel_type = 'PLACED' and b.rel_type = 'CONTAINS' and a.source_id in ('Customer:1', 'Customer:2')"


@query(
    _CHAIN2 + ") select distinct source_id, source_label, rel_type, target_id, target_label from (select n0 as source_id, 'Customer' as source_label, 'PLACED' as rel_type, n1 as target_id, 'Order' as target_label from paths union all select n1, 'Order', 'CONTAINS', n2, 'Part' from paths)"
)
def chained_2hop(spark, sf_dir):
    return t.chained(from_tables(spark, sf_dir), ["Customer:1", "Customer:2"], "Customer", [t.Hop("PLACED", "Order"), t.Hop("CONTAINS", "Part")], None)


@query(
    f"""with {EDGES}, paths as (
    select a.source_id as n0, a.target_id as n1, b.target_id as n2, c.target_id as n3 from edges a join edges b on a.target_id = b.source_id join edges c on b.target_id = c.source_id
    where a.rel_type = 'PLACED' and b.rel_type = 'CONTAINS' and c.rel_type = 'MADE_BY' and a.source_id in ('Customer:1', 'Customer:2') order by n0, n1, n2, n3 limit 100)
    select distinct * from (select n0 as source_id, 'Customer' as source_label, 'PLACED' as rel_type, n1 as target_id, 'Order' as target_label from paths
    union all select n1, 'Order', 'CONTAINS', n2, 'Part' from paths union all select n2, 'Part', 'MADE_BY', n3, 'Supplier' from paths)"""
)
def chained_3hop(spark, sf_dir):
    return t.chained(from_tables(spark, sf_dir), ["Customer:1", "Customer:2"], "Customer", [t.Hop("PLACED", "Order"), t.Hop("CONTAINS", "Part"), t.Hop("MADE_BY", "Supplier")])


def _trails(ids: str, most: int, least: int = 1) -> str:
    return f"""with recursive {EDGES}, walk as (
    select source_id as start_id, target_id as end_id, 1 as hops, [source_id || '~' || rel_type || '~' || target_id] as path from edges where source_id in ({ids})
    union all select w.start_id, e.target_id, w.hops + 1, list_append(w.path, e.source_id || '~' || e.rel_type || '~' || e.target_id) from walk w join edges e on e.source_id = w.end_id
    where w.hops < {most} and not list_contains(w.path, e.source_id || '~' || e.rel_type || '~' || e.target_id))
    , steps as (select distinct unnest(path) as k from walk where hops >= {least} and start_id <> end_id)
    select {COLUMNS} from edges join steps on k = source_id || '~' || rel_type || '~' || target_id"""


@query(_trails("'Customer:1', 'Part:5'", 2))
def variable_hop_1_2(spark, sf_dir):
    return t.variable_hop(from_tables(spark, sf_dir), ["Customer:1", "Part:5"], 1, 2, None)


@query(_trails("'Customer:1', 'Part:5'", 3))
def variable_hop_1_3(spark, sf_dir):
    return t.variable_hop(from_tables(spark, sf_dir), ["Customer:1", "Part:5"], 1, 3, None)


@query(_trails("'Supplier:90'", 2, 2))
def variable_hop_2_2(spark, sf_dir):
    return t.variable_hop(from_tables(spark, sf_dir), ["Supplier:90"], 2, 2, None)


def _levels(most: int) -> str:
    """Breadth-first levels l1 to l<most> from every a, with the least path to each node newly reached."""
    first = "l1 as (select a, target_id as spot, min([a, target_id]) as nodes from (select distinct a from pairs) join both_ways on source_id = a where target_id <> a group by 1, 2)"
    new = lambda k: " ".join(f"and not exists (select 1 from l{i} s where s.a = l{k - 1}.a and s.spot = target_id)" for i in range(1, k))
    return ", ".join([first, *(f"l{k} as (select l{k - 1}.a, target_id as spot, min(list_append(nodes, target_id)) as nodes from l{k - 1} join both_ways on source_id = l{k - 1}.spot where target_id <> l{k - 1}.a {new(k)} group by 1, 2)" for k in range(2, most + 1))])


@query(
    f"""with {EDGES}, {BOTH}, seeds as (select unnest(['Customer:1', 'Nation:1', 'Supplier:1']) as id), pairs as (select x.id as a, y.id as b from seeds x join seeds y on x.id < y.id),
    {_levels(t.SHORTEST_HOPS)},
    found as ({" union all ".join(f"select * from l{k}" for k in range(1, t.SHORTEST_HOPS + 1))})
    select pairs.a, pairs.b, (len(nodes) - 1)::int as n_hops, array_to_string(nodes, ' ') as path from pairs join found on found.a = pairs.a and spot = pairs.b"""
)
def shortest_path_pairs(spark, sf_dir):
    found = t.shortest_paths(from_tables(spark, sf_dir), ["Customer:1", "Nation:1", "Supplier:1"])
    return found.select("a", "b", (F.size("nodes") - 1).alias("n_hops"), F.array_join("nodes", " ").alias("path"))


@query(_trails("'Nation:1'", 6))
def shortest_path_single(spark, sf_dir):
    return t.shortest_path(from_tables(spark, sf_dir), ["Nation:1"])


@query(
    f"""with {EDGES}, {BOTH}, near as (select distinct {COLUMNS} from both_ways where source_id in ('Supplier:1', 'Supplier:2')),
    shared as (select target_id from near group by 1 having count(distinct source_id) >= 2) select {COLUMNS} from near join shared using (target_id)"""
)
def shared_neighbor(spark, sf_dir):
    return t.shared_neighbor(from_tables(spark, sf_dir), ["Supplier:1", "Supplier:2"])


@query("select x.id as a, y.id as b from (select unnest(['Part:1', 'Part:2', 'Order:9']) as id) x join (select unnest(['Part:1', 'Part:2', 'Order:9']) as id) y on x.id < y.id")
def entry_pairs(spark, sf_dir):
    return t.entry_pairs(from_tables(spark, sf_dir), ["Part:1", "Part:2", "Order:9"])


_RANKED = f"with {EDGES}, {NODES}, few as (select {COLUMNS} from edges where source_id in ('Supplier:1', 'Customer:7') order by {KEY} limit 30), ranked as (select *, (row_number() over (order by {KEY}) - 1)::int as ord from few)"
_ENTRY_NODES = ", first_seen as (select id, min(ord)::int as ord from (select 'Supplier:1' as id, -2 as ord union all select 'Customer:7', -1 union all select source_id, ord * 2 from ranked union all select target_id, ord * 2 + 1 from ranked) group by 1), sub_nodes as (select id, label, name, ord from first_seen left join nodes using (id))"


def _general(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    ids = ["Supplier:1", "Customer:7"]
    edges = t.ordered(t.general(g, ids))
    return g, edges, t.subgraph_nodes(g, edges, ids)


@query(_RANKED + _ENTRY_NODES + " select * from sub_nodes")
def subgraph_nodes(spark, sf_dir):
    return _general(spark, sf_dir)[2]


@query(_RANKED + " select source_id, target_id, rel_type, ord from ranked where rel_type = 'SUPPLIES' order by ord limit 25")
def subgraph_filter(spark, sf_dir):
    return ranking.filter_edges(_general(spark, sf_dir)[1], "SUPPLIES")


@query(_RANKED + _ENTRY_NODES + ", kept as (select * from ranked where rel_type = 'SUPPLIES' order by ord limit 25) select id, label, name, ord from (select *, row_number() over (order by ord) - 1 as at_pos from sub_nodes) where at_pos < 10 or id in (select source_id from kept union select target_id from kept)")
def subgraph_pruned_nodes(spark, sf_dir):
    g, edges, nodes = _general(spark, sf_dir)
    return ranking.prune_nodes(nodes, ranking.filter_edges(edges, "SUPPLIES"))


@query(_RANKED + _ENTRY_NODES + " select source_id, source_label, rel_type, target_id, target_label, ord from ranked where source_id in (select id from sub_nodes where label <> 'Order') and target_id in (select id from sub_nodes where label <> 'Order')")
def dangling_edges_dropped(spark, sf_dir):
    g, edges, nodes = _general(spark, sf_dir)
    return ranking.drop_dangling(edges, nodes.where("label <> 'Order'"))


@query(
    _RANKED + _ENTRY_NODES + """, scored as (select source_id, rel_type, target_id, ranked.ord,
    least(100, 10 + case when rel_type = 'SUPPLIES' then 40 when contains(lower(rel_type), 'supplies') then 20 else 0 end
    + least(30, 15 * len(list_intersect(list_distinct(list_filter(string_split_regex(lower(coalesce(s.name, '') || ' ' || coalesce(d.name, '')), '\\s+'), lambda w: w <> '')), ['which', 'red', 'parts', 'does', 'supplier#000000001', 'supply'])))
    + case when length(rel_type) > 3 then 10 else 0 end + case when contains(rel_type, '_') then 10 else 0 end)::int as points
    from ranked left join sub_nodes s on s.id = source_id left join sub_nodes d on d.id = target_id) select * from (select source_id, rel_type, target_id, ord, points from scored order by points desc, ord limit 20)"""
)
def edge_score_topk(spark, sf_dir):
    g, edges, nodes = _general(spark, sf_dir)
    return ranking.score_edges(edges, nodes, "SUPPLIES", "Which red parts does Supplier#000000001 supply")


@query(_RANKED + _ENTRY_NODES + ", named as (select id, coalesce(nullif(name, ''), label) as shown from sub_nodes) select rel_type, count(*) as n, arg_min(coalesce(a.shown, '?') || ' → ' || coalesce(b.shown, '?'), ord) as example from ranked left join named a on a.id = source_id left join named b on b.id = target_id group by 1")
def pattern_rel_histogram(spark, sf_dir):
    g, edges, nodes = _general(spark, sf_dir)
    return ranking.rel_histogram(edges, nodes)


@query(_RANKED + _ENTRY_NODES + " select label, count(*) as n from sub_nodes group by 1")
def pattern_label_histogram(spark, sf_dir):
    return ranking.label_histogram(_general(spark, sf_dir)[2])


@query(
    _RANKED + _ENTRY_NODES + """, named as (select id, coalesce(nullif(name, ''), label) as shown from sub_nodes)
    select 1 as section, ord, '  - [' || label || '] ' || coalesce(nullif(name, ''), '(unnamed)') as line from sub_nodes
    union all select * from (select 2, ord, '  - ' || case rel_type when 'LOCATED_IN' then coalesce(a.shown, 'Unknown') || ' is located in ' || coalesce(b.shown, 'Unknown') else coalesce(a.shown, 'Unknown') || ' --' || rel_type || '--> ' || coalesce(b.shown, 'Unknown') end
    from ranked left join named a on a.id = source_id left join named b on b.id = target_id order by ord limit 20)"""
)
def context_lines(spark, sf_dir):
    g, edges, nodes = _general(spark, sf_dir)
    return ranking.context_lines(nodes, edges, {"LOCATED_IN": "{source} is located in {target}"})


@query(
    """with named as (select n_name as name, 'Nation:' || n_nationkey::varchar as id, 'Nation' as label from nation union all select r_name, 'Region:' || r_regionkey::varchar, 'Region' from region), rels as (select n_name as source, 'WITHIN' as rel_type, r_name as target from nation join region on n_regionkey = r_regionkey)
    select distinct a.id as source_id, a.label as source_label, rel_type, '{}' as rel_props, b.id as target_id, b.label as target_label from rels join named a on a.name = source join named b on b.name = target"""
)
def edge_resolve_by_name(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    nation, region = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    rels = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.lit("WITHIN").alias("type"), F.col("r_name").alias("target"))
    return resolve_by_name(g.labelled(["Nation", "Region"]), rels)


@query(
    f"""with {EDGES}, {NODES}, few as (select {COLUMNS} from edges where rel_type = 'LOCATED_IN' and source_id in ('Supplier:1', 'Supplier:2'))
    select source_id, source_label, s.name as source_name, rel_type, '{{}}' as rel_props, target_id, target_label, t.name as target_name from few join nodes s on s.id = source_id join nodes t on t.id = target_id"""
)
def edge_rows_with_properties(spark, sf_dir):
    """The full edge row; of the ends' properties their names, as SQL has them."""
    g = from_tables(spark, sf_dir)
    rows = t.with_properties(g, t.targeted(g, ["Supplier:1", "Supplier:2"], "LOCATED_IN"))
    name = lambda end: F.get_json_object(f"{end}_props", "$.name").alias(f"{end}_name")
    return rows.select("source_id", "source_label", name("source"), "rel_type", "rel_props", "target_id", "target_label", name("target"))


@query(f"with {NODES} select id, label, name from nodes where label in ('Nation', 'Supplier')")
def node_scan_labels(spark, sf_dir):
    return from_tables(spark, sf_dir).labelled(["Nation", "Supplier"]).select("id", "label", "name")


@query(
    f"""with {NODES}, parts as (select 0 as part, (row_number() over (order by id) - 1)::int as ord, id, label, name from nodes where label = 'Region' union all
    select 1, (row_number() over (order by id) - 1)::int, id, label, name from nodes where label in ('Region', 'Nation'))
    select id, arg_min(part, part * 1000 + ord) as part, arg_min(ord, part * 1000 + ord) as ord, any_value(label) as label, any_value(name) as name from parts group by id"""
)
def agent_merge_subgraphs(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    part = lambda n, labels: g.labelled(labels).select(F.lit(n).alias("part"), F.expr("cast(row_number() over (order by id) - 1 as int)").alias("ord"), "id", "label", "name")
    return ranking.merge_nodes(part(0, ["Region"]).unionByName(part(1, ["Region", "Nation"])))


def flagship(spark, sf_dir):
    """What the orders of a customer, found by name, contain: edges and the names at their ends."""
    g = from_tables(spark, sf_dir)
    ids = [r.id for r in g.properties.where("label = 'Customer' and key = 'name'").where(F.lower("value") == "customer#000000001").select("id").collect()] or ["Customer:1"]
    return t.chained(g, ids, "Customer", [t.Hop("PLACED", "Order"), t.Hop("CONTAINS", "Part")])
