"""Durable staging of intermediate tables, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Python workers give freed memory back instead of keeping it for the next task, beside which another one may run.
WORKER_MEMORY = {"MALLOC_TRIM_THRESHOLD_": str(2 << 20), "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch sent to them: Spark's default, and ours where it stands.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package (a cluster may also install it), and keep their memory small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    name, default, own = BATCH_BYTES
    if spark.conf.get(name) == default:
        spark.conf.set(name, own)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="terrazzo-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/terrazzo-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: the result survives lost executors. The JVM removes
    the files when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
