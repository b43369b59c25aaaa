"""What several operators share: Arrow plumbing, private names, a small union-find."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpoint  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from wherever the driver did, and get batches of a few MB.

    Spark sends up to 64 MB at a time by default; texts, their words and the results of a
    batch are in memory together, in every worker, so the size of a batch is what bounds it.
    A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def dealt(df: DataFrame) -> DataFrame:
    """A table that would fit in one split of a file (``spark.sql.files.maxPartitionBytes``), dealt to all cores; others as they are.

    A small file often is a single row group, which one core would read and work on alone.
    """
    spark = df.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if int(str(estimate)) <= size else df


def private(name: str, *frames: DataFrame) -> str:
    """``name``, with ``_`` added until no column of the frames has it, in whatever case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a string column; null becomes empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of a hash and a mark, some 100 bytes each in memory, that are broadcast; beyond that the join is dealt.
FEW = 200_000


def _marked(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    few = F.broadcast(keys) if keys.count() <= FEW else keys
    return docs.join(few, (F.xxhash64(docs[f"`{id_col}`"]) == keys["h"]) & (F.md5(utf8(docs[f"`{text_col}`"])) == keys["mark"]), how)


def matching(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (h: xxhash64 of the id, mark: MD5 of the text; checkpointed) names."""
    return _marked(docs, keys, id_col, text_col, "left_semi")


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keys`` does not name."""
    return _marked(docs, keys, id_col, text_col, "left_anti")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on single record batches."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def spanning_forest(pairs) -> list[tuple[int, int]]:
    """(smallest member, member) for every member but the smallest of each component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(r, x) for x in parent if (r := find(x)) != x]
