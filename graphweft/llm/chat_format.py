"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The turns that both conversations begin with are the prompt, rendered once; what follows is
a completion each, with a mask of the characters to learn from: the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    """Text that cannot be taken for a marker: ``<|`` is broken by a space."""
    return F.regexp_replace(text, r"<\|", "< |")


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns: array of (role, text)), in order of turn, then role, then text."""
    turn = F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.select(quoted(conv_col).alias("conv"), turn.alias("t")).where("conv is not null").groupBy("conv").agg(ordered.alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _escaped(t["role"]), F.lit("\n"), _escaped(t["text"]), F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """start:end, comma-joined, of the assistant's words and closing marks in the rendered completion, in code points."""
    head = lambda t: F.length(_escaped(t["role"])) + F.lit(len(OPEN) + 1)
    body = lambda t: F.length(_escaped(t["text"])) + F.lit(len(CLOSE))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + head(t)
        end = start + body(t)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["spans"]), ",")


def preference_pairs(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each of ``pairs`` (pair_id, chosen_id, rejected_id).

    prompt: the longest common prefix of whole turns (role and text equal), rendered;
    n_prompt_turns; chosen and rejected: the turns after it, rendered; chosen_mask and
    rejected_mask: the spans of each to learn from. So prompt + chosen is the whole chosen
    conversation.

    Null roles and texts are empty; a null turn number comes first; turns of one number go
    by role, then text, and repeats stay. Equal conversations leave both completions empty;
    a conversation that is missing or null has no turns. Turns of one conversation meet in
    one row, as they must to be rendered; nothing else is gathered.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    chosen, rejected = (turns.select(F.col("conv").alias(f"{x}_conv"), F.col("turns").alias(x)) for x in ("c", "r"))
    own = pairs.select("pair_id", "chosen_id", "rejected_id")
    joined = own.join(chosen, F.col("chosen_id") == F.col("c_conv"), "left").join(rejected, F.col("rejected_id") == F.col("r_conv"), "left")
    return _formatted(joined.select("pair_id", "chosen_id", "rejected_id", *[F.coalesce(x, F.array().cast("array<struct<role:string,text:string>>")).alias(x) for x in ("c", "r")]))


def _formatted(pairs: DataFrame) -> DataFrame:
    equal = F.transform(F.arrays_zip("c", "r"), lambda z: z["c"].eqNullSafe(z["r"]))
    unequal_at = F.array_position(equal, False)
    common = F.when(unequal_at > 0, unequal_at - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int")
    after = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    cut = pairs.withColumn("n", common).select("pair_id", "chosen_id", "rejected_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), after("c").alias("c"), after("r").alias("r"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )


def adjacent_pairs(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of the conversations 2n (chosen) and 2n + 1 (rejected); a null where only one of them exists."""
    ids = conversations.select(quoted(conv_col).cast("long").alias("id")).where("id is not null").distinct()
    even = F.col("id") % 2 == 0
    return ids.groupBy(F.floor(F.col("id") / 2).cast("long").alias("pair_id")).agg(F.max(F.when(even, F.col("id"))).alias("chosen_id"), F.max(F.when(~even, F.col("id"))).alias("rejected_id"))


ORACLE = r"""
with turns as (
    select conv_id, list({'role': replace(coalesce(role, ''), '<|', '< |'), 'text': replace(coalesce(text, ''), '<|', '< |'), 'raw': [coalesce(role, ''), coalesce(text, '')]} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t
    from conversations where conv_id is not null group by conv_id
), ids as (
    select conv_id // 2 as pair_id, max(case when conv_id % 2 = 0 then conv_id end) as chosen_id, max(case when conv_id % 2 = 1 then conv_id end) as rejected_id from turns group by 1
), pairs as (
    select pair_id, chosen_id, rejected_id, coalesce(a.t, []) as c, coalesce(b.t, []) as r
    from ids left join turns a on a.conv_id = chosen_id left join turns b on b.conv_id = rejected_id
), cut as (
    select *, coalesce((select min(i) - 1 from (select unnest(range(1, least(len(c), len(r)) + 1)) as i) where c[i].raw <> r[i].raw), least(len(c), len(r))) as n from pairs
), parts as (
    select pair_id, chosen_id, rejected_id, n, side, unnest(t) as t, generate_subscripts(t, 1) as i
    from (select pair_id, chosen_id, rejected_id, n, 'p' as side, c[1:n] as t from cut union all select pair_id, chosen_id, rejected_id, n, 'c', c[n + 1:] from cut union all select pair_id, chosen_id, rejected_id, n, 'r', r[n + 1:] from cut)
), rendered as (
    select pair_id, side, i, t.role as role, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as line, length(t.role) as head from parts
), placed as (
    select *, coalesce(sum(length(line)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as pos from rendered
), sides as (
    select pair_id, side, string_agg(line, '' order by i) as body,
        string_agg((pos + head + 13)::bigint::varchar || ':' || (pos + length(line) - 1)::bigint::varchar, ',' order by i) filter (role = 'assistant') as mask
    from placed group by pair_id, side
)
select cut.pair_id, cut.chosen_id, cut.rejected_id, cut.n::bigint as n_prompt_turns, coalesce(p.body, '') as prompt, coalesce(c.body, '') as chosen, coalesce(c.mask, '') as chosen_mask, coalesce(r.body, '') as rejected, coalesce(r.mask, '') as rejected_mask
from cut left join sides p on p.pair_id = cut.pair_id and p.side = 'p' left join sides c on c.pair_id = cut.pair_id and c.side = 'c' left join sides r on r.pair_id = cut.pair_id and r.side = 'r'
"""
