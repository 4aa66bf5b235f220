"""Series kept in a store, a folder of Parquet partitions by ticker: read through it, and only what is stale is fetched, merged and written again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import newer_wins, staleness
from .scratch import written
from .tables import BAR


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """What the store has; nothing where there is no store yet."""
    columns = [c.split()[0] for c in BAR.split(", ")]
    try:
        return spark.read.schema(BAR.split(", ", 1)[1] + ", ticker string").parquet(path).select(*columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BAR)


def replace_series(bars: DataFrame, path: str) -> None:
    """Replace the partitions of the tickers in bars; those of other tickers are not touched."""
    bars.repartition("ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def stale_tickers(stored: DataFrame, wanted: DataFrame, today: Column, days: int) -> DataFrame:
    """The wanted tickers (ticker) that the store has not, or whose last date is more than days before today."""
    found = staleness(stored, today, days)
    return wanted.select("ticker").distinct().join(found, "ticker", "left").where("stale IS NULL OR stale").select("ticker")


def read_through(spark: SparkSession, path: str, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], today: Column, days: int) -> DataFrame:
    """The series of the wanted tickers. Stale ones are fetched first: fetch gets them as a table (ticker) and returns their bars, which win over stored ones of the same date.

    Only stale partitions are read for the merge and written. The merged rows are written aside before they replace anything, so a lost executor leaves the store as it was.
    """
    stored = stored_bars(spark, path)
    stale = written(stale_tickers(stored, wanted, today, days), "stale-tickers")
    fresh = written(fetch(stale).join(stale, "ticker", "left_semi").select(stored.columns), "fetched-bars")
    old = stored.join(fresh.select("ticker").distinct(), "ticker", "left_semi")
    replace_series(written(newer_wins(old, fresh, ["ticker", "date"]), "merged-bars"), path)
    return stored_bars(spark, path).join(wanted.select("ticker").distinct(), "ticker", "left_semi")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], hours: float, now: float | None = None) -> DataFrame:
    """A table that is kept in a folder for so many hours: made and written where there is none or it is too old; made each time, and not kept, for hours of 0 or less. now: seconds, the clock if not given."""
    if hours <= 0:
        return make()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")  # a write that broke off has none
    age = (time.time() if now is None else now) - files.getFileStatus(done).getModificationTime() / 1000 if files.exists(done) else None
    if age is None or age >= hours * 3600:
        written(make(), "cached").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
