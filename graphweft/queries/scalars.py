"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import query


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@query(r"select p_partkey, trim(lower(replace(regexp_replace('HasPart_' || p_type || 'isOf ', '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '))) as name from part")
def humanize_names(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.humanize(F.concat(F.lit("HasPart_"), "p_type", F.lit("isOf "))).alias("name"))


@query("select p_partkey, case when v like '%es' then left(v, length(v) - 1) || 'd' when v like '%s' then left(v, length(v) - 1) || 'ed' when v like '%e' then v || 'd' else v || 'ed' end as verb from (select p_partkey, p_name || case p_partkey % 4 when 0 then 'es' when 1 then 's' when 2 then 'e' else '' end as v from part)")
def past_participles(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 4 == 0, "es").when(F.col("p_partkey") % 4 == 1, "s").when(F.col("p_partkey") % 4 == 2, "e").otherwise("")
    return _part(spark, sf_dir).select("p_partkey", tx.past_participle(F.concat("p_name", suffix)).alias("verb"))


@query("select p_partkey, lower(p_brand) || '_' || lower(p_type) as name from part")
def intent_names(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.intent_name(F.col("p_brand"), F.col("p_type")).alias("name"))


@query("select p_partkey, p_name || ' is located in ' || p_brand as line from part")
def filled_templates(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.fill(tx.template_for(F.lit("located in")), F.col("p_name"), F.col("p_brand")).alias("line"))


@query("select page_id, 'db@' || regexp_extract(url, '^[^:/]+://(?:[^@/]*@)?([^:/?#]+)', 1) as name from pages")
def default_graph_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tx.default_graph_name(F.col("url"), F.lit("db")).alias("name"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as names from part")
def comma_lists(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", F.array_join(tx.comma_list(F.concat("p_name", F.lit(" , ,"), "p_brand")), "|").alias("names"))


@query("select p_partkey, case when p_partkey % 3 > 0 then p_name || '|' || p_brand end as questions from part")
def json_string_lists(spark, sf_dir):
    reply = F.when(F.col("p_partkey") % 3 > 0, F.to_json(F.array("p_name", "p_brand", "p_type"))).otherwise("none, sorry")
    return _part(spark, sf_dir).select("p_partkey", F.array_join(tx.json_strings(reply, 2), "|").alias("questions"))


@query("select p_partkey, lower(regexp_replace(p_brand || ' _' || p_type || '.', '[^A-Za-z0-9_]', '', 'g')) as intent from part")
def intent_replies(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.intent_reply(F.concat("p_brand", F.lit(" _"), "p_type", F.lit("."))).alias("intent"))


@query("select p_partkey, translate(lower(p_brand || '_A-b'), '_-', '') as key from part")
def property_name_keys(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", tx.plain_key(F.concat("p_brand", F.lit("_A-b"))).alias("key"))


@query("select conv_id, left(string_agg(text, chr(10) || '---' || chr(10) order by turn), 2000) as context from conversations where trim(text) <> '' group by 1")
def joined_contexts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    return turns.select("conv_id", tx.joined_context(F.col("texts")).alias("context"))


@query("select event_id, case when v in ('true', 'false') then 'BOOLEAN' when regexp_full_match(v, '[+-]?[0-9]+') then 'INTEGER' when regexp_full_match(v, '[+-]?[0-9]+[.][0-9]*') then 'FLOAT' when v like '[%]' then 'LIST' else 'STRING' end as kind from (select event_id, case event_id % 5 when 0 then user_id::varchar when 1 then round(value, 2)::varchar when 2 then 'true' when 3 then '[' || user_id::varchar || ']' else event_type end as v from events)")
def value_types(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    v = F.when(m == 0, user).when(m == 1, F.round("value", 2).cast("string")).when(m == 2, "true").when(m == 3, F.concat(F.lit("["), user, F.lit("]"))).otherwise(F.col("event_type"))
    return e.select("event_id", tx.value_type(v).alias("kind"))


@query("select p_partkey, round(2.0::double * n / (length(a) + length(b)), 6) as ratio from (select p_partkey, p_brand as a, p_brand || 'x' as b, length(p_brand) as n from part)")
def indel_ratios(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", F.round(tx.indel_ratio(F.col("p_brand"), F.concat("p_brand", F.lit("x"))), 6).alias("ratio"))
