"""Tables that an operator writes to the folder all executors share, to cut lineage between its steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a new temporary folder if all tasks run on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of the rows that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session to give Python workers at most BATCH_BYTES at once, unless its bound is lower: by Spark's, a batch is 10,000 rows however long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of each query within go when it ends; else they stay until the driver happens to collect garbage, and those of steps that are done add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Named Parquet tables below one new folder of the shared directory.

    A lost executor costs a rerun of the tasks of one step only, since every later step reads what is on
    shared storage. ``drop`` removes a table that no later step reads; what the returned DataFrame still
    reads stays, and goes with the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Drop every table but those named. Without names, what an operator's result no longer needs: all of it."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(root):
            self.drop(*(n for n in (s.getPath().getName() for s in files.listStatus(root)) if n not in names))
