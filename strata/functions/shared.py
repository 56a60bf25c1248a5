"""A folder that driver and executors share, for what one query writes and reads again."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(found or _own()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own() -> str:
    made = tempfile.mkdtemp(prefix="strata-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder, read again: it cuts the lineage and outlives executors.  ``forget`` removes it."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes tables that ``written`` made; nothing may read them afterwards."""
    for frame in frames:
        session = frame.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(frame._path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
