"""Graph construction over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import construction as c
from ..sources.graph import from_tables
from .registry import PROPS, query


@query()
def chunk_documents(spark, sf_dir):
    return c.chunk_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_size=800, overlap=40)


@query()
def split_sentences(spark, sf_dir):
    return c.split_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TRIPLES = "triples as (select p_name as head, 'made of/' || p_type as relation, p_brand as tail, 'Part' as head_type, case when p_size > 25 then 'Event' else 'Brand' end as tail_type, p_size from part)"


def _triples(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_name").alias("head"), F.concat(F.lit("made of/"), "p_type").alias("relation"), F.col("p_brand").alias("tail"), F.lit("Part").alias("head_type"), F.when(F.col("p_size") > 25, "Event").otherwise("Brand").alias("tail_type"))


@query("select p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace('  ' || p_name || '  THING', '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name from part")
def normalise_entity(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.entity_name(F.concat(F.lit("  "), "p_name", F.lit("  THING"))).alias("name"))


@query("select p_partkey, regexp_replace(regexp_replace(upper(trim('made of/' || p_type || ' - ' || p_brand)), '[\\s\\-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g') as name from part")
def normalise_relation(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.relation_name(F.concat(F.lit("made of/"), "p_type", F.lit(" - "), "p_brand")).alias("name"))


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^(a|an|the)\\s+', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select p_partkey, {_KEY.format(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + '-X  ' + chr(39) + ' || p_brand')} as key from part")
def entity_key(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.entity_key(F.concat(F.lit("The "), "p_name", F.lit("-X  "), "p_brand")).alias("key"))


_TITLE = "array_to_string(list_transform(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    f"""with {_TRIPLES}, names as (select head as name from triples union all select tail from triples), counted as (select name, count(*) as n, {_KEY.format('name')} as key from names group by 1),
    canon as (select key, arg_min(name, (-n, name)) as name from counted group by 1), titled as (select key, {_TITLE.format("regexp_replace(name, '^\\s*(a|an|the)\\s+', '', 'i')")} as canonical from canon),
    keys as (select distinct {_KEY.format('head')} as hk, relation, {_KEY.format('tail')} as tk from triples)
    select h.canonical as head, relation, t.canonical as tail from keys join titled h on h.key = hk join titled t on t.key = tk"""
)
def resolve_entities(spark, sf_dir):
    return c.resolve_entities(_triples(spark, sf_dir).select("head", "relation", "tail"))[0]


@query(f"with {_TRIPLES} select relation, count(*) as n, string_agg(distinct head_type, ',' order by head_type) as source_types, string_agg(distinct tail_type, ',' order by tail_type) as target_types from triples group by 1")
def induce_relations(spark, sf_dir):
    return c.induce_relations(_triples(spark, sf_dir))


@query(f"with {_TRIPLES} select distinct head_type as type, head as entity from triples union select distinct tail_type, tail from triples")
def induce_types(spark, sf_dir):
    return c.induce_types(_triples(spark, sf_dir))


@query(f"with {_TRIPLES} select head, relation, tail, head_type, tail_type from triples where tail_type = 'Event'")
def event_triples(spark, sf_dir):
    return c.event_triples(_triples(spark, sf_dir))[1]


@query("select initcap_name as head, upper(event_type) as relation, 'K' as tail, '' as head_type, '' as tail_type, value / 100 as confidence, event_id::varchar as source_chunk from (select *, 'User' || user_id::varchar as initcap_name from events) where value / 100 >= 0.2 and event_id % 7 <> 0")
def extract_triples(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    head = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    reply = F.to_json(F.array(F.struct(head.alias("head"), F.col("event_type").alias("relation"), F.lit("k").alias("tail"), (F.col("value") / 100).alias("confidence"))))
    return c.extract_triples(e.select(F.col("event_id").alias("chunk"), reply.alias("reply")), min_confidence=0.2)


_MEMBERS = "members as (select distinct l_suppkey % 40 as type, l_partkey % 797 as entity from lineitem)"


def _members(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_suppkey") % 40).alias("type"), (F.col("l_partkey") % 797).alias("entity")).distinct()


@query(f"with {_MEMBERS}, n as (select type, count(*) as n from members group by 1), met as (select a.type as a, b.type as b, count(*) as k from members a join members b using (entity) where a.type < b.type group by 1, 2) select a, b, round(k / (x.n + y.n - k), 6) as similarity from met join n x on x.type = a join n y on y.type = b where k / (x.n + y.n - k) >= 0.7".replace("k / (", "k::double / ("))
def jaccard_merge(spark, sf_dir):
    return c.jaccard_pairs(_members(spark, sf_dir))


@query(
    f"""with recursive {_MEMBERS}, n as (select type, count(*) as n from members group by 1), met as (select a.type as a, b.type as b, count(*) as k from members a join members b using (entity) where a.type <> b.type group by 1, 2),
    pairs as (select a, b from met join n x on x.type = a join n y on y.type = b where k::double / (x.n + y.n - k) >= 0.7), reach as (select type as a, type as b from n union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a)
    select a as type, min(b) as merged from reach group by 1"""
)
def jaccard_merged_types(spark, sf_dir):
    return c.merge_types(_members(spark, sf_dir))


@query(
    f"""with {PROPS}, kinds as (select label, key, case when value is null or trim(value) = '' then null when lower(value) in ('true', 'false') then 'BOOLEAN' when regexp_full_match(trim(value), '[+-]?[0-9]+') then 'INTEGER'
    when regexp_full_match(trim(value), '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') then 'FLOAT' when regexp_full_match(trim(value), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*') then 'DATE' else 'STRING' end as k from props),
    sets as (select label, key, list_sort(list(distinct k)) as kinds from kinds where k is not null group by 1, 2)
    select label, key, case when len(kinds) = 1 then kinds[1] when kinds = ['FLOAT', 'INTEGER'] then 'FLOAT' else 'STRING' end as data_type from sets"""
)
def infer_types(spark, sf_dir):
    return c.infer_types(from_tables(spark, sf_dir).properties)


@query(
    """with recursive parents as (select 'N' || n_nationkey::varchar as type, 'R' || n_regionkey::varchar as parent from nation union all select 'R' || r_regionkey::varchar, case when r_regionkey > 0 then 'R' || (r_regionkey - 1)::varchar end from region),
    up as (select type, parent as ancestor, 1 as depth from parents where parent is not null union all select up.type, p.parent, up.depth + 1 from up join parents p on p.type = up.ancestor where p.parent is not null)
    select type, ancestor, depth from up"""
)
def type_hierarchy(spark, sf_dir):
    nation, region = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    name = lambda p, c_: F.concat(F.lit(p), F.col(c_).cast("string"))
    up = F.when(F.col("r_regionkey") > 0, F.concat(F.lit("R"), (F.col("r_regionkey") - 1).cast("string")))
    return c.type_hierarchy(nation.select(name("N", "n_nationkey").alias("type"), name("R", "n_regionkey").alias("parent")).unionAll(region.select(name("R", "r_regionkey"), up)))


@query(
    """with old_types as (select p_type as name, count(*) as n from part where p_size <= 25 and p_type < 'P' group by 1), seen as (select case when p_size > 40 then p_type || 'S' else p_type end as name, count(*) as n from part group by 1)
    select s.name, case when o.name is not null then 'KNOWN' when exists (select 1 from old_types x where s.name = x.name || 'S') then 'ALIAS' else 'NEW' end as change, (s.n + coalesce(o.n, 0))::bigint as n from seen s left join old_types o on lower(o.name) = lower(s.name)"""
)
def schema_diff(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = p.where("p_size <= 25 and p_type < 'P'").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    seen = p.groupBy(F.when(F.col("p_size") > 40, F.concat("p_type", F.lit("S"))).otherwise(F.col("p_type")).alias("name")).agg(F.count("*").alias("n"))
    return c.schema_diff(old, seen, threshold=0.9)


@query("with recursive parents as (select 'N' || n_nationkey::varchar as type, 'R' || n_regionkey::varchar as parent from nation union all select 'R' || r_regionkey::varchar, case when r_regionkey > 0 then 'R' || (r_regionkey - 1)::varchar end from region), up as (select type, parent as ancestor, 1 as depth from parents where parent is not null union all select up.type, p.parent, up.depth + 1 from up join parents p on p.type = up.ancestor where p.parent is not null) select p.type, coalesce(max(depth), 0)::int as depth from (select distinct type from parents) p left join up using (type) group by 1")
def type_depths(spark, sf_dir):
    nation, region = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    name = lambda p, c_: F.concat(F.lit(p), F.col(c_).cast("string"))
    up = F.when(F.col("r_regionkey") > 0, F.concat(F.lit("R"), (F.col("r_regionkey") - 1).cast("string")))
    return c.type_depths(nation.select(name("N", "n_nationkey").alias("type"), name("R", "n_regionkey").alias("parent")).unionAll(region.select(name("R", "r_regionkey"), up)))
