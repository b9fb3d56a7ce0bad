"""Tables that cut lineage, in the folder every executor shares.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets
one under the machine's temporary folder; on a cluster it must be named.
A table is written once and read back, so a lost executor costs no recomputation.
``clear`` removes what this application has written, once its results are saved; ``scope`` what
was written inside it.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scopes that are open.
_open: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared scratch folder of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="barometry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A path of its own for a table called name."""
    return "/".join([root(spark), *_open, f"{name}-{uuid.uuid4().hex[:12]}"])


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end; what reads them must be saved outside before."""
    _open.append(f"scope-{uuid.uuid4().hex[:12]}")
    path = "/".join([root(spark), *_open])
    try:
        yield
    finally:
        _open.pop()
        remove(spark, path)


def cut(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """frame, written to the scratch folder and read back."""
    path = place(frame.sparkSession, name)
    frame.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this application's scratch tables; results that read them must be saved before."""
    remove(spark, root(spark))
