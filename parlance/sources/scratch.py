"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: A side of a join is broadcast only if it was counted and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


@functools.cache
def own_folder() -> str:
    """A temporary folder of this process, gone with it."""
    own = tempfile.mkdtemp(prefix="parlance-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, local runs take a temporary folder; a cluster has no such folder that all see."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
    return (found or own_folder()).rstrip("/")


def removed(path: str) -> None:
    """Delete a folder in the shared one, as far as it can be reached."""
    try:
        where, root = fs.FileSystem.from_uri(path)
        where.delete_dir(root)
    except (OSError, ValueError):
        pass


@functools.cache
def application_folder(root: str, application: str) -> str:
    """The folder of one application's tables, which goes when its driver ends."""
    path = f"{root}/parlance/{application}"
    atexit.register(removed, path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application."""
    return f"{application_folder(shared_root(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`settled` that nothing will read again."""
    for table in tables:
        removed(table.settled_at)


def hinted(df: DataFrame, row_bytes: int | Column = 64) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small; ``row_bytes`` is a bound of a row's size, or a column of it."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df
