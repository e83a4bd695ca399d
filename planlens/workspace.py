"""Where intermediate tables live, and how the package reaches the executors.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder, so a
lost executor costs a retry of its running tasks and nothing else.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share.

    Only a session of one machine (tests) that names none gets a temporary one.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all machines of the cluster share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="planlens-shared-")
        spark.conf.set(CHECKPOINT_SETTING, root)
    return root.rstrip("/")


class Scratch:
    """Named tables of one run of an operator, below the shared folder.

    A returned DataFrame may still read them, so they stay until ``drop()``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/planlens/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``frame`` once and return the reread table."""
        frame.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def _folder(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def drop(self, name: str | None = None) -> None:
        system, target = self._folder(self.path(name) if name else self.base)
        system.delete(target, True)

    def drop_others(self, *names: str) -> None:
        """Drop all tables but these, which a result still reads."""
        system, target = self._folder(self.base)
        for status in system.listStatus(target) if system.exists(target) else []:
            if status.getPath().getName() not in names:
                system.delete(status.getPath(), True)


#: Rows of a partition where tasks sort or aggregate whole partitions, and how few are worth a task of their own; speed and memory only.
DEALT_ROWS, LEAST_ROWS = 200_000, 20_000


def partitions_for(spark: SparkSession, rows: int, most: int = DEALT_ROWS) -> int:
    """Into how many partitions to deal so many rows; Spark doesn't join partitions of a given number."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


_SHIPPED: dict[str, bool] = {}

#: Bytes of the batches that Spark hands to a Python worker: with rows alone as the bound, long texts would fill it.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application, and bound the session's Arrow batches in bytes."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if _SHIPPED.get(app):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="planlens-code-"), "planlens.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.join("planlens", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = True
