"""Questions: keywords, matches, intents, similarity and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import memory, retrieval
from ..plans import agent, evaluation
from ..sources.graph import from_tables
from ..streaming.memory_stats import windowed_counts
from .registry import PROPS, query

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def _keywords(source: str) -> str:
    """(conv_id, turn, ord, candidate) of a text table."""
    return f"""toks as (select conv_id, turn, list_filter(string_split_regex(trim(lower(regexp_replace(text, '[^a-zA-Z0-9\\s\\-]', ' ', 'g'))), '\\s+'), lambda w: w <> '') as all_words from {source}),
    base as (select conv_id, turn, case when len(list_filter(all_words, lambda w: not list_contains({_STOP}, w))) > 0 then list_filter(all_words, lambda w: not list_contains({_STOP}, w)) else all_words end as w from toks),
    grams as (select conv_id, turn, list_concat(list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')), list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' '))), w) as g from base),
    flat as (select conv_id, turn, unnest(g) as candidate, generate_subscripts(g, 1) as pos from grams)"""


@query(f"with {_keywords('conversations')}, firsts as (select conv_id, turn, candidate, min(pos) as pos from flat group by 1, 2, 3) select conv_id, turn, candidate, (row_number() over (partition by conv_id, turn order by pos) - 1)::int as ord from firsts")
def extract_keywords(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return retrieval.candidates(turns).select("conv_id", "turn", "candidate", "ord")


_NAMES = ["customer#000000007", "red widget", "nation_3", "small", "ring", "nowhere", "nation_31"]


def _names(spark, names=_NAMES):
    return spark.createDataFrame([(n,) for n in names], "candidate string")


def _values(names=_NAMES):
    return f"with {PROPS}, names as (select unnest([{', '.join(repr(n) for n in names)}]) as candidate), vals as (select id, label, lower(value) as value from props where ((key = 'name') or (label = 'Order' and key in ('priority', 'status'))) and value is not null)"


@query(_values() + " select candidate, id, label from (select candidate, id, label, row_number() over (partition by candidate order by id) as rk from (select distinct candidate, id, label from names join vals on value = candidate)) where rk <= 10")
def match_exact(spark, sf_dir):
    return retrieval.match_exact(from_tables(spark, sf_dir), _names(spark))


@query(_values() + " select candidate, id, label from (select candidate, id, label, row_number() over (partition by candidate order by id) as rk from (select distinct candidate, id, label from names join vals on contains(value, candidate))) where rk <= 10")
def match_partial(spark, sf_dir):
    return retrieval.match_partial(from_tables(spark, sf_dir), _names(spark))


#: Indel ratios of the couples of ``banded``, as SQL.
_LCS = """pairs as (select distinct candidate, value from banded),
    lcs as (select candidate, value, 0 as i, list_transform(range(0, length(value) + 1), lambda x: 0) as line from pairs union all
        select candidate, value, i + 1, list_reduce(list_transform(range(1, length(value) + 1), lambda j: [j]), lambda acc, x: list_append(acc, (case when value[x[1]] = candidate[i + 1] then line[x[1]] + 1 else greatest(line[x[1] + 1], acc[len(acc)]) end)::bigint), [0::bigint])
        from lcs where i < length(candidate)),
    scored as (select candidate, value, 2.0::double * line[len(line)] / (length(candidate) + length(value)) as score from lcs where i = length(candidate))"""
_FUZZY = ["natin_3", "red wdget", "regon_1", "smal ring"]


@query(
    _values(_FUZZY).replace("with ", "with recursive ", 1) + """, primary_vals as (select id, label, lower(value) as value from props where (key = 'name' or (label = 'Order' and key = 'priority')) and value is not null),
    banded as (select candidate, id, label, value from (select *, row_number() over (partition by candidate order by id) as rk from names join primary_vals on length(value) between greatest(length(candidate) - length(candidate) // 2, 1) and length(candidate) + length(candidate) // 2) where rk <= 200),
    """ + _LCS + """
    select candidate, id, label, round(score, 6) as score from (select candidate, id, label, score, row_number() over (partition by candidate order by score desc, id) as rk from banded join scored using (candidate, value) where score >= 0.85) where rk <= 5"""
)
def match_fuzzy(spark, sf_dir):
    return retrieval.match_fuzzy(from_tables(spark, sf_dir), _names(spark, _FUZZY)).withColumn("score", F.round("score", 6))


_ASKED = {0: ("Which red widget?", ["red widget", "red", "widget"]), 1: ("nation_3", ["nation 3", "nation", "3"]), 2: ("Which smal ring?", ["smal ring", "smal", "ring"])}


@query(
    f"""with recursive {PROPS}, vals as (select id, label, key, lower(value) as value from props where ((key = 'name') or (label = 'Order' and key in ('priority', 'status'))) and value is not null),
    asked as (select * from (values {", ".join(f"({q}, {c!r}, {n})" for q, (_, own) in _ASKED.items() for n, c in enumerate(own))}) t(query_id, candidate, ord)),
    exact as (select distinct candidate, id, label, 1 as stage from (select candidate, id, label, row_number() over (partition by candidate order by id) as rk from (select distinct candidate, id, label from asked join vals on value = candidate)) where rk <= 10),
    part as (select distinct candidate, id, label, 2 as stage from (select candidate, id, label, row_number() over (partition by candidate order by id) as rk from (select distinct candidate, id, label from asked join vals on contains(value, candidate) where candidate not in (select candidate from exact))) where rk <= 10),
    rest as (select distinct candidate from asked where length(candidate) > 3 and candidate not in (select candidate from exact union all select candidate from part)),
    banded as (select candidate, id, label, value from (select *, row_number() over (partition by candidate order by id) as rk from rest join vals on length(value) between greatest(length(candidate) - length(candidate) // 2, 1) and length(candidate) + length(candidate) // 2 where key <> 'status') where rk <= 200),
    {_LCS},
    fuzzy as (select candidate, id, label, 3 as stage from (select candidate, id, label, row_number() over (partition by candidate order by score desc, id) as rk from banded join scored using (candidate, value) where score >= 0.85) where rk <= 5),
    found as (select * from exact union all select * from part union all select * from fuzzy)
    select query_id, id, label, arg_min(stage, ord) as stage, min(ord) as ord from asked join found using (candidate) group by 1, 2, 3"""
)
def extract_entities(spark, sf_dir):
    asked = spark.createDataFrame([(q, text) for q, (text, _) in _ASKED.items()], "query_id int, text string")
    return retrieval.extract(from_tables(spark, sf_dir), asked)


@query(
    """with asked as (select 'vec ' || vec_id as candidate, embedding::double[] as e from embeddings where vec_id in (7, 11, 23)),
    scored as (select candidate, vec_id::varchar as id, label::varchar as label, round(list_cosine_similarity(embedding::double[], e), 6) as score from embeddings, asked)
    select candidate, id, label, score from (select *, row_number() over (partition by candidate order by score desc, id) as rk from scored where score >= 0.2) where rk <= 3"""
)
def match_semantic(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = table.where("vec_id in (7, 11, 23)").select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("candidate"), F.col("embedding").alias("asked"))
    return retrieval.match_semantic(table.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), "embedding"), asked, 0.2)


_INTENTS = [("connection", ["connected", "how is", "onou"]), ("overview", ["the on", "reth"]), ("shared", ["in common", "both", "er er"])]
_MARKERS = "[" + ", ".join(f"'{m}'" for m in retrieval.ABSTRACT_MARKERS) + "]"


@query(
    "with intents as (select * from (values " + ", ".join(f"({i}, '{n}', {kw!r})" for i, (n, kw) in enumerate(_INTENTS)) + f""") t(ord, name, keywords)), hits as (select conv_id, turn, arg_min(name, ord) as hit from conversations, intents where len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0 group by 1, 2)
    select conv_id, turn, coalesce(hit, case when len(list_filter({_MARKERS}, lambda m: contains(lower(text), m))) > 0 then 'abstract' end, 'general') as intent from conversations left join hits using (conv_id, turn) where role = 'user'"""
)
def classify_intents(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", "text")
    intents = spark.createDataFrame([(i, n, kw) for i, (n, kw) in enumerate(_INTENTS)], "ord int, name string, keywords array<string>")
    return retrieval.classify(asked, intents).select("conv_id", "turn", "intent")


@query("with q as (select embedding::double[] as e from embeddings where vec_id = 7) select vec_id as id, round(list_cosine_similarity(embedding::double[], e), 6) as score from embeddings, q where list_cosine_similarity(embedding::double[], e) >= 0.2 order by score desc, id limit 5")
def semantic_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = [float(x) for x in vectors.where("id = 7").first()["embedding"]]
    return retrieval.semantic(vectors, asked, 0.2, 5)


_NOW = 1_706_659_200  # 2024-01-31 00:00 UTC, just after the newest event


def _memories(spark, sf_dir):
    """Memories from the tables: each vector is a past question of the domain of its label, a minute apart."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("query_text"), F.col("embedding").alias("query_embedding"), F.lit("").alias("answer"), F.lit("").alias("context"), F.lit("general").alias("intent"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), (F.lit(float(_NOW)) - F.col("vec_id") * 60).alias("timestamp"))


@query(
    f"""with q as (select embedding::double[] as e from embeddings where vec_id = 7), newest as (select * from embeddings where label = 3 order by vec_id limit 500)
    select vec_id::varchar as id, 'question ' || vec_id::varchar as query_text, '' as answer, '' as context, 'general' as intent, round(list_cosine_similarity(embedding::double[], e), 6) as similarity, (vec_id * 60)::double as age_seconds
    from newest, q where round(list_cosine_similarity(embedding::double[], e), 6) >= 0.05 order by similarity desc, age_seconds, id limit 3"""
)
def memory_recall(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 7").first()["embedding"]
    return memory.recall(_memories(spark, sf_dir), F.array(*[F.lit(float(x)) for x in asked]), "d3", _NOW, 0.05, 3)


@query(f"select count(*) as total, count(*) filter (epoch(ts) > {_NOW} - 3600) as last_hour from events")
def memory_stats(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").cast("double").alias("timestamp"), F.col("event_type").alias("domain"))
    return memory.stats(events, _NOW)


@query("select date_trunc('hour', ts) as window_start, event_type as key, count(*) as n from events group by 1, 2")
def memory_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return windowed_counts(events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_RUNS = "select conv_id as run, case when role = 'system' then 'out_of_scope' else 'general' end as intent, (length(text) % 4)::int as facts, text as context from conversations"


@query(f"with r as ({_RUNS}), g as (select run, sum(facts)::bigint as facts, bool_and(intent = 'out_of_scope') as none_in, bool_or(trim(coalesce(context, '')) <> '') as has_some from r group by 1) select run, facts, case when none_in then true else facts >= 5 and has_some end as sufficient, case when none_in then 0.0::double else least(1.0::double, facts / 10.0::double) end as coverage from g")
def agent_evaluate(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return agent.evaluate_all(turns.select(F.col("conv_id").alias("run"), F.when(F.col("role") == "system", "out_of_scope").otherwise("general").alias("intent"), (F.length("text") % 4).alias("facts"), F.col("text").alias("context")))


@query("select round(coalesce(avg((toxic = 0)::int), 0) * 100, 4) as pass_rate from labels")
def eval_pass_rate(spark, sf_dir):
    return evaluation.pass_rate(spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("toxic") == 0).alias("passed")))


_SEEN = "select 'case' || user_id::varchar as name, count(*)::int as facts, list_sort(list(distinct event_type)) as types from events group by 1"


@query(
    f"""with seen as ({_SEEN}), f as (select name, facts, list_sort(list_filter(types, lambda x: not list_contains(['click', 'view', 'purchase', 'error'], x))) as odd, list_sort(list_intersect(types, ['error'])) as barred from seen),
    m as (select name, list_filter([case when facts < 60 then 'facts ' || facts::varchar end, case when len(odd) > 0 then 'unexpected ' || array_to_string(odd, ',') end, case when len(barred) > 0 then 'forbidden ' || array_to_string(barred, ',') end], lambda x: x is not null) as failures from f)
    select name, 'coverage' as category, len(failures) = 0 as passed, case when len(failures) = 0 then 'PASS' else array_to_string(failures, '; ') end as details from m"""
)
def eval_suite(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = events.groupBy(F.concat(F.lit("case"), F.col("user_id").cast("string")).alias("name")).agg(F.count("*").cast("int").alias("facts"), F.collect_set("event_type").alias("rel_types"))
    results = seen.select("name", F.lit("coverage").alias("category"), F.lit("general").alias("intent"), F.lit("general").alias("strategy"), "facts", "rel_types", F.lit(None).cast("string").alias("answer"), F.lit(False).alias("called_model"), F.lit(1.0).alias("latency_ms"))
    cases = seen.select("name", F.lit(None).cast("string").alias("expect_intent"), F.lit("general").alias("expect_strategy"), F.lit(60).alias("expect_min_facts"), tx.strings(["click", "view", "purchase", "error"]).alias("expect_rel_types"), tx.strings(["error"]).alias("expect_no_rel_types"), F.lit(None).cast("array<string>").alias("expect_answer_contains"), F.lit(True).alias("expect_no_llm_call"), F.lit(100.0).alias("max_latency_ms"))
    return evaluation.verdicts(results, cases)


@query("with s as (select user_id, list_sort(list(distinct event_type)) as types from events group by 1) select user_id, array_to_string(list_sort(list_filter(types, lambda x: not list_contains(['click', 'view'], x))), ',') as odd, array_to_string(list_sort(list_intersect(types, ['error', 'purchase'])), ',') as barred from s")
def eval_rel_types(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    return s.select("user_id", listed(F.array_except("types", tx.strings(["click", "view"]))).alias("odd"), listed(F.array_intersect("types", tx.strings(["error", "purchase"]))).alias("barred"))


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings")
def cosine_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return e.select("vec_id", F.round(tx.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in first])), 6).alias("score"))
