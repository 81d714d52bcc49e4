"""Scratch tables in the folder that driver and executors share.

``table`` cuts lineage, so a lost executor costs its own tasks alone. Every folder goes when the driver ends, and
earlier where ``release`` is called: by operators for what their result no longer reads, by callers for the rest. The
shuffle files of a table go as soon as it is written, as nothing reads them again.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made so far, and the temporary folder of a local session that names none, by application.
_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}
#: Spark's setting by which an action's shuffle files go with its end, not with a collection of the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many are within ``shuffles_go``, and what the setting was before the first, by session.
_within: dict[str, tuple[int, str]] = {}
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session that names none gets a temporary folder if it runs in one
    process, and an error on a cluster, whose executors could not read it."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _local.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-scratch-")
        _local[context.applicationId] = path
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _hadoop(spark, path)
    return store.exists(place)


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in the folder ``path``; none if it is not there."""
    store, place = _hadoop(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Rename the folder ``made`` to ``path`` in one step; false, and nothing changed, if ``path`` is there already."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    store, place = _hadoop(spark, path)
    store.mkdirs(place.getParent())
    source = store.makeQualified(hadoop.Path(made))
    context = hadoop.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, store.makeQualified(place), gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        if store.exists(place):
            return False
        raise e
    return True


def new_folder(spark: SparkSession, name: str = "t") -> str:
    """A name in the shared folder that nothing has yet; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, place = _hadoop(spark, path)
    store.deleteOnExit(place)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends. The last of a session's threads to leave puts the setting back."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _within.get(session) or (0, spark.conf.get(CLEANUP, "false"))
        _within[session] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _within.pop(session)
            if n > 1:
                _within[session] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = new_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """A mark for ``release``: how many folders there are."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders made after the mark ``since``, but for the last ``keep``. Their tables cannot be read any more."""
    held = _made.get(spark.sparkContext.applicationId, [])
    gone = held[since : len(held) - keep]
    for path in gone:
        store, place = _hadoop(spark, path)
        store.delete(place, True)
    held[since : len(held) - keep] = []
