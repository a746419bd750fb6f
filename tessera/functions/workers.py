"""What jobs share: the package's path for Python workers, and a folder for derived tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that Spark hands to a Python worker; by rows alone, 10,000 long texts or pages would be one.
BATCH_BYTES = 4 << 20
#: Compression of stored tables: packs texts into fewer bytes than Spark's default.
PACKED = "zstd"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it through ``sys.path`` only."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches for Python workers by bytes, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; a local session without it uses this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "spark-shared")
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: for what several branches of a plan read, so that it is computed once."""
    path = f"{shared_root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does so when the driver collects its garbage, else not before the end of the query."""
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the folders of a table that ``stored`` wrote, and frees what its making left; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)
    free(df.sparkSession)
