"""Lineage cuts that survive the loss of executors.

A staged table is written to the folder that all executors share, named by the session setting
``spark.checkpoint.dir``. Only where that setting is absent, and only in local mode (tests), a folder is made here.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_MADE: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables. Raises on a cluster that names none: a machine-local folder would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="alinea-")
        spark.sparkContext.setCheckpointDir(f"file://{_LOCAL[app]}")
    return f"file://{_LOCAL[app]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so later plans neither recompute nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/alinea-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(_drop_all)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, folder: str, names: tuple[str, ...], label: str, make: Callable[[], object]):
    """What ``make`` gives (staged tables), made once a session for a folder's tables ``names`` as they are now.

    A table that was written anew has another time or length, so what was made of it before isn't used again; nor is
    what someone has deleted from the shared folder.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    stamps = []
    for n in names:
        path = fs.Path(f"{folder}/{n}.parquet")
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps.append((n, status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, folder, label, *stamps)
    if key not in _MADE or not _still_there(spark, _MADE[key]):
        _MADE[key] = make()
    return _MADE[key]


def _still_there(spark: SparkSession, made) -> bool:
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = {f.rsplit("/", 1)[0] for df in (made if isinstance(made, tuple) else (made,)) for f in df.inputFiles()}
    paths = [path_of(f) for f in folders]
    return all(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in paths)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads, given as ``staged`` returned them or as columns of them. Others are left alone."""
    for df in tables:
        for where in {f.split("://", 1)[-1].rsplit("/", 1)[0] for f in df.inputFiles()}:
            for spark, path in [w for w in _WRITTEN if w[1].split("://", 1)[-1].lstrip("/") == where.lstrip("/")]:
                _delete(spark, path)
                _WRITTEN.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
