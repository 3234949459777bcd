"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary folder of the session if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        session = spark.sparkContext.applicationId
        if session not in _OWN:
            _OWN[session] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            spark.sparkContext.setCheckpointDir(_OWN[session])
        found = _OWN[session]
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: later stages start from replicated files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def writers(df: DataFrame, each: int) -> int:
    """Tasks to write something of ``df`` with: one for each ``each`` bytes that its plan estimates, as many as cores at least, as shuffle partitions at most.

    A local store starts processes for every file (``chmod``), and any store is slow with many small ones.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(spark.sparkContext.defaultParallelism, min(-(-size // each), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if there is one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
