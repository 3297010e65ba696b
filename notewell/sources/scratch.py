"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session that names no shared folder; executors' own disks would lose rows."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='notewell-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def is_local(master: str) -> bool:
    return master.split("[")[0] == "local"


#: Bytes of input files to a partition where each task sorts or groups what it holds.
SLICE_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def slices(df: DataFrame) -> int:
    """How many partitions keep a task's rows bounded: in proportion to the files that ``df`` reads, a core each at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // SLICE_BYTES))


class Scratch:
    """A folder of its own below the shared one."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/notewell-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """Write ``df`` and read it back; ``release`` lets go of the shuffle files of its making."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        if release:
            del df
            self.release()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def release(self) -> None:
        """Spark deletes the shuffle files of finished jobs once the driver has collected its garbage."""
        for _ in range(3):  # the first round frees what the later ones' objects are held by
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.4)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
