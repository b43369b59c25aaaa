"""Schema discovery and the configuration derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, configuration, schema
from ..sources.graph import from_tables
from .registry import EDGES, NODES, PROPS, query


@query(f"with {NODES} select distinct label from nodes")
def schema_labels(spark, sf_dir):
    return schema.labels(from_tables(spark, sf_dir))


@query(f"with {NODES} select label, count(*) as n from nodes group by 1")
def schema_node_counts(spark, sf_dir):
    return schema.node_counts(from_tables(spark, sf_dir))


@query(f"with {EDGES} select rel_type, source_label, target_label, count(*) as n from edges group by 1, 2, 3")
def schema_rel_patterns(spark, sf_dir):
    return schema.relationship_patterns(from_tables(spark, sf_dir))


@query(f"with {NODES}, {EDGES} select (select count(*) from nodes) as total_nodes, (select count(*) from edges) as total_relationships")
def schema_totals(spark, sf_dir):
    return schema.totals(from_tables(spark, sf_dir))


@query(f"with {PROPS} select distinct label, key from props")
def schema_property_keys(spark, sf_dir):
    return schema.property_keys(from_tables(spark, sf_dir))


_PROFILE = f"""with {PROPS}, distinct_values as (select distinct label, key, value from props where value is not null),
profile as (select p.label, p.key, count(value) as n_values, count(distinct value) as n_distinct, round(coalesce(count(distinct value)::double / nullif(count(value), 0), 0), 6) as unique_ratio, any_value(type) as type from props p group by 1, 2),
samples as (select label, key, string_agg(value, '|' order by value) as sample from (select *, row_number() over (partition by label, key order by value) as rk from distinct_values) where rk <= 3 group by 1, 2)"""


@query(_PROFILE + " select profile.*, sample from profile join samples using (label, key)")
def schema_property_profile(spark, sf_dir):
    return schema.property_profile(from_tables(spark, sf_dir)).withColumn("sample", F.array_join("sample", "|"))


@query(
    _PROFILE + """, scored as (select label, key, type, case when key in ('name') then 40 else 0 end + case when unique_ratio > 0.5 then 30 else 0 end + case when type = 'String' then 30 else 0 end as points from profile),
    best as (select label, max(points) as best, min(case when type = 'String' then key end) as first_string from scored group by 1)
    select label, key, points from scored join best using (label) where points > 50 or (best <= 50 and key = first_string)"""
)
def schema_searchable(spark, sf_dir):
    return schema.searchable(schema.property_profile(from_tables(spark, sf_dir)))


@query(f"with {NODES}, {EDGES} select source_id as id, any_value(name) as name, count(*) as degree from edges join nodes on id = source_id where source_label = 'Supplier' group by 1 order by degree desc, id limit 5")
def label_topk_degree(spark, sf_dir):
    return schema.top_degree(from_tables(spark, sf_dir), "Supplier")


@query(
    f"""with {EDGES}, outs as (select rel_type, max(d) as max_out from (select rel_type, source_id, count(*) as d from edges group by 1, 2) group by 1),
    ins as (select rel_type, max(d) as max_in from (select rel_type, target_id, count(*) as d from edges group by 1, 2) group by 1)
    select rel_type, max_out, max_in, case when max_out <= 1 and max_in <= 1 then '1:1' when max_in <= 1 then '1:N' when max_out <= 1 then 'N:1' else 'M:N' end as cardinality from outs join ins using (rel_type)"""
)
def edge_cardinality(spark, sf_dir):
    return schema.cardinality(from_tables(spark, sf_dir))


def _bound(end: str) -> str:
    return f"{end}s as (select rel_type, source_label, target_label, case when count(*) < any_value(n.n) then 0 else min(d) end as low, max(d) as high from (select rel_type, source_label, target_label, {end}_id, count(*) as d from edges group by all) join n on label = {end}_label group by all)"


@query(f"with {NODES}, {EDGES}, n as (select label, count(*) as n from nodes group by 1), {_bound('source')}, {_bound('target')} select rel_type, source_label, target_label, '[' || s.low || '..' || s.high || '] -> [' || t.low || '..' || t.high || ']' as notation from sources s join targets t using (rel_type, source_label, target_label)")
def edge_cardinality_bounds(spark, sf_dir):
    return schema.cardinality_bounds(from_tables(spark, sf_dir))


@query(f"with {NODES}, {PROPS}, have as (select label, key, count(value) as n_values from props group by 1, 2), n as (select label, count(*) as n from nodes group by 1) select label, key, case when n_values = n then 'MANDATORY' else 'OPTIONAL' end as constraint from have join n using (label)".replace("as constraint", 'as "constraint"'))
def property_constraint(spark, sf_dir):
    return schema.constraints(from_tables(spark, sf_dir))


_PATTERNS = f"with {EDGES}, pats as (select rel_type as type, source_label, target_label, count(*) as n from edges group by 1, 2, 3), ranked as (select (row_number() over (order by n desc, type, source_label, target_label) - 1)::int as ord, * from pats)"
_HUMAN = "trim(lower(replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')))"
_H, _S, _T = _HUMAN.format("type"), _HUMAN.format("source_label"), _HUMAN.format("target_label")
_PAST = f"case when {_H} like '%es' then left({_H}, length({_H}) - 1) || 'd' when {_H} like '%s' then left({_H}, length({_H}) - 1) || 'ed' when {_H} like '%e' then {_H} || 'd' else {_H} || 'ed' end"
_TARGETED = f""", named as (
    select ord * 2 as ord, lower(source_label) || '_' || lower(type) as name, list_concat([{_H}, {_T} || ' of', 'what ' || {_T}, 'what does it ' || {_H}, {_H} || ' ' || {_T}], list_filter(string_split({_H}, ' '), lambda w: length(w) > 3)) as kw from ranked
    union all select ord * 2 + 1, lower(target_label) || '_' || lower(type) || '_reverse', [{_PAST} || ' by', 'what ' || {_H}, 'which ' || {_S}, 'what ' || {_S}] from ranked
), targeted as (select name, arg_min(kw, ord) as kw from named group by 1)"""
_CHAINS = f""", joined as (select a.ord as a_ord, b.ord as b_ord, a.source_label as entry_label, a.type as type1, a.target_label as label1, b.type as type2, b.target_label as label2 from ranked a join ranked b on a.target_label = b.source_label where a.type <> b.type and b.target_label <> a.source_label),
chained as (select *, 'chain_' || replace({_HUMAN.format('type1')}, ' ', '_') || '_to_' || replace({_HUMAN.format('type2')}, ' ', '_') as name,
    ['indirectly ' || {_HUMAN.format('type2')}, {_HUMAN.format('type1')} || ' then ' || {_HUMAN.format('type2')}, 'through ' || {_HUMAN.format('label1')}, 'leads to ' || {_HUMAN.format('label2')}] as kw from joined)"""


def _patterns(spark, sf_dir):
    return configuration.ranked_patterns(schema.relationship_patterns(from_tables(spark, sf_dir)))


@query(_PATTERNS + _CHAINS + " select name, entry_label, type1, label1, type2, label2, array_to_string(kw, '|') as keywords from chained")
def detect_chains(spark, sf_dir):
    return configuration.chains(_patterns(spark, sf_dir)).drop("a_ord", "b_ord").withColumn("keywords", F.array_join("keywords", "|"))


@query(_PATTERNS + _TARGETED + " select name, array_to_string(list_sort(list_distinct(kw)), '|') as keywords from targeted")
def auto_keywords(spark, sf_dir):
    return configuration.targeted_intents(_patterns(spark, sf_dir)).select("name", F.array_join("keywords", "|").alias("keywords"))


@query(
    _PATTERNS + _TARGETED + _CHAINS + """, every_intent as (select name, 'targeted' as strategy, 4 as prio from targeted where name not in ('neighborhood', 'connection', 'shared') union all select distinct name, 'chained', 0 from chained
    union all select unnest(['neighborhood', 'connection', 'shared']), unnest(['variable_hop', 'shortest_path', 'shared_neighbor']), unnest([3, 2, 1]))
    select name, strategy, (row_number() over (order by prio, name) - 1)::int as ord from every_intent"""
)
def auto_intents(spark, sf_dir):
    return configuration.intents(_patterns(spark, sf_dir)).select("name", "strategy", "ord")


@query(_PATTERNS + f" select distinct type, case {_H} when 'located in' then '{{source}} is located in {{target}}' else '{{source}} ' || {_H} || ' {{target}}' end as template from ranked")
def auto_templates(spark, sf_dir):
    return configuration.templates(_patterns(spark, sf_dir))


@query(
    _PATTERNS + _TARGETED + _CHAINS + " select strategy, count(*) as n from (select 'targeted' as strategy from targeted union all select 'chained' from (select distinct name from chained) union all select unnest(['variable_hop', 'shortest_path', 'shared_neighbor'])) group by 1"
)
def registry_strategy_counts(spark, sf_dir):
    return catalog.strategy_counts(configuration.intents(_patterns(spark, sf_dir)))
