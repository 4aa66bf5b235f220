"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder, for local masters only; it goes when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder they share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read several times is made once, and later stages restart from its files."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, folder: str) -> tuple[tuple[str, int], ...]:
    """Names and modification times of what lies in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return tuple(sorted((f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(path)))


def stored(spark: SparkSession, key: tuple[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this key (a name and the folder it is made of), made and written at its first use in an application, and again once something in the folder has changed."""
    key = (spark.sparkContext.applicationId, *key, stamp(spark, key[1]))
    if key not in _KEPT:
        _KEPT[key] = written(make(), key[1])
    return _KEPT[key]
