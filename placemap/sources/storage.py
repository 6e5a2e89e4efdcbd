"""Tables written between the steps of a long job."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; only a local session may do without one."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="placemap-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete every step table this process has made, once no result reads them any more; how many there were."""
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def stored(table: DataFrame, label: str = "step") -> DataFrame:
    """Write the table and read it back: the plan starts anew and lost executors cost no recomputation."""
    spark = table.sparkSession
    path = new_path(spark, label)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
