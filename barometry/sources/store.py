"""Tables that Spark writes once and reads again, in the folder that all executors share."""

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Unset, a folder under the warehouse's serves a local session; on a cluster it must be named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_barometry"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table, or for a stream's state and output."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """frame, written and read back; what reads it computes nothing of it again."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: it changes when the table does."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return ";".join(sorted(f"{s.getPath().getName()},{s.getLen()},{s.getModificationTime()}" for s in system.listStatus(place)))


def once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() gives, derived once in a session for a state of its input tables, and read from then on."""
    key = hashlib.sha256("|".join([name, *(f"{p}:{state_of(spark, p)}" for p in inputs)]).encode()).hexdigest()[:16]
    path = f"{shared_root(spark)}/{name}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
