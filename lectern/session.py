"""Session for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Puts the folder of this package on the Python workers' path; a cluster that has it installed needs nothing.

    Also turns off Spark 4.1's reuse of partitioning across unions: with adaptive
    execution it zips partitions that were coalesced differently.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # texts are long: batches of the default 10,000 rows cost each Python worker, and the JVM beside it, several times 30 MB
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@lru_cache(maxsize=8)
def process_folder(root: str) -> str:
    """One folder for all tables of this process; it goes when the process ends in order, if its session is still there."""
    path = f"{root}/lectern-{uuid.uuid4().hex}"

    def drop() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(drop)
    return path


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder among this process's tables."""
    return f"{process_folder(shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, for what several later steps read: it is worked out once, and an executor that is lost later costs nothing."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
