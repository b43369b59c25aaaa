"""Mixing sources to target weights.

The sizes of each source are summed once; from its weight and size each source gets a
target and, as target over size, a repetition rate. A document is taken floor(rate) times
and once more if a number in [0, 1) drawn from its id and a seed is below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, private, quoted

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on nothing but the key as text (null: empty) and the seed: 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) for a table of one row per source, (source, source_size).

    Sources by code point, null last, have ``weights`` over and over and divide ``share``
    times the total size; no target exceeds ``cap`` times its source's size, and what is
    over goes to the others by weight. So each target is the lower of its limit and its
    weight times one common level. With sources in order of limit over weight, filling all
    before a source leaves it a level that rises up to the first source that isn't full and
    falls from there on, so the common level is the highest. The windows hold one row per
    source.
    """
    ranked = sizes.selectExpr("source", "source_size", "row_number() over (order by source is null, source) - 1 as at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("weight", weight.cast("long")).withColumn("total", F.expr("sum(source_size) over ()"))
    return (
        limits.selectExpr(
            "*",
            "coalesce(sum(source_size) over (order by source_size / weight, at rows between unbounded preceding and 1 preceding), 0) as full",
            "sum(weight) over (order by source_size / weight, at rows between current row and unbounded following) as open",
        )
        .selectExpr("*", f"({share}D * total - {cap}D * full) / open as level")
        .selectExpr("*", f"max(level) over () as common")
        .selectExpr("source", "source_size", f"round(least({cap}D * source_size, common * weight), 6) as target")
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(id, size, source_size, target, copies) for each row of ``docs``.

    A null source is a source of its own, the last; a null, empty or white text has size 0
    and is drawn like the others; sources without words have target 0 and no copies. Rows
    that repeat an id are drawn alike. An empty table gives an empty result. Texts are read
    once: what is joined and kept are numbers. The table of sources is joined by Spark's
    own choice, broadcast only if its measured size allows; else a hot source is split.
    """
    sizes = checkpoint(docs.select(quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("source"), word_count(quoted(text_col)).alias("size")))
    aims = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumnRenamed("source", "of")
    joined = sizes.join(aims, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, size, source_size, target, taken): words of each row, of its source, the source's target, and the words taken."""
    return plan(docs, id_col, **options).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", copy_col: str = "copy", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, numbered from 1 in ``copy_col``.

    A table that has a column of that name, in whatever case, gets one with ``_`` added.

    Only the table of sources is joined to the rows, so texts are not shuffled for it.
    """
    copy_col = private(copy_col, docs)
    of, rate = private("__of", docs), private("__rate", docs)
    sizes = docs.groupBy(quoted(source_col).cast("string").alias("source")).agg(F.sum(word_count(quoted(text_col))).alias("source_size"))
    aims = checkpoint(targets(sizes, weights, share, cap)).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    if aims.count() <= 100_000:  # one short row per source; beyond that, a join that splits hot sources
        aims = F.broadcast(aims)
    joined = docs.join(aims, docs[f"`{source_col}`"].cast("string").eqNullSafe(F.col(of)))
    copies = F.floor(F.col(rate)) + (draw(docs[f"`{id_col}`"], seed) < F.col(rate) - F.floor(F.col(rate))).cast("long")
    numbered = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(numbered).alias(copy_col))


ORACLE = r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
    select source, sum(size)::bigint as source_size from sized group by source
), limits as (
    select source, source_size, row_number() over (order by source is null, source) - 1 as pos,
        ([5, 2, 1])[1 + ((row_number() over (order by source is null, source) - 1) % 3)::int]::bigint as weight, (sum(source_size) over ())::bigint as total
    from sources
), levels as (
    select *, (1.5::double * total - 2.0::double * coalesce((sum(source_size) over (order by source_size::double / weight, pos rows between unbounded preceding and 1 preceding))::bigint, 0))
        / (sum(weight) over (order by source_size::double / weight, pos rows between current row and unbounded following))::bigint as level
    from limits
), aims as (
    select source, source_size, round(least(2.0::double * source_size, (select max(level) from levels) * weight), 6) as target
    from levels
), rates as (
    select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from aims
)
select doc_id, size, source_size, target,
    (size * (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized join rates on sized.source is not distinct from rates.source
"""
