"""State that outlives a plan: checkpoints in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Without that setting a local session, such as a test's, gets a temporary folder; on a
    cluster, where executors and driver share no such folder, it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables in the shared folder, for loops that join what they wrote before.

    A checkpoint hands the optimizer's size estimates on; join after join those multiply, and
    after some twenty rounds the numbers have so many digits that planning takes longer than
    the work. A table has the size of its files. What is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.root = f"{_folder(spark)}/tables-{uuid.uuid4().hex}"
        self._on_disk("deleteOnExit", self.root)

    def _on_disk(self, do: str, path: str, *args) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(at.getFileSystem(self.spark._jsc.hadoopConfiguration()), do)(at, *args)

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.root}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, *tables: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            self._on_disk("delete", path, True)
