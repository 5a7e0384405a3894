"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it names none a temporary folder is
    taken, but only if driver and executors are one process: on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``scratch`` or the end of the driver clears."""
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    _WRITTEN.pop(path, None)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of the shared folder, which cuts its lineage: a lost
    executor then costs a read, not a recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, if it did."""
    path = getattr(df, "_lamina_path", None)
    if path:
        drop_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables written within, but those put into the list."""
    before, kept = set(_WRITTEN), []
    try:
        yield kept
    finally:
        keep = {getattr(df, "_lamina_path", None) for df in kept}
        for path in [p for p in _WRITTEN if p not in before and p not in keep]:
            drop_path(spark, path)


@atexit.register
def _clear() -> None:
    """What no scope has cleared goes with the driver."""
    for path, spark in list(_WRITTEN.items()):
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            continue
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return
