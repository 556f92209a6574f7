"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; only where it names none, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return base.rstrip("/")


#: Paths that this process has made and not yet discarded, in order.
_made: list[str] = []


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/smsward-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point to which discard() may go back."""
    return len(_made)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables made since a mark, but for the last `keep` of them: when all that is read from them has been written or consumed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stop = len(_made) - keep
    for path in _made[since:stop]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    del _made[since:stop]
