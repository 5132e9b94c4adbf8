"""Tables written to the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (a
local session, as in tests) a folder under the driver's temp directory is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, object] = {}
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tideline-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tideline/{uuid.uuid4().hex}/{name}"
    _made[path] = spark
    if len(_made) == 1:
        atexit.register(_clean)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a
    lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path in _made:
            _remove(_made.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already; the folder is scratch
            return
