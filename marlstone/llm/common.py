"""Shared helpers: written tables in the shared folder, rolling hashes, union-find and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

#: ASCII white space, as the contracts define it.
SPACES = " \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages restart from the files."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- rolling hash -----------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """Powers 0 to n of the base (k = 0) or of its inverse (k = 1), modulo 2**64."""
    if len(_powers[k]) <= n:
        size = max(n + 1, 2 * len(_powers[k]))
        steps = np.full(size, (_BASE, _INVERSE)[k], np.uint64)
        steps[0] = 1
        _powers[k] = np.cumprod(steps)
    return _powers[k][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """Hashes of any substrings of data by their content alone, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * _power(0, n)[:n], out=self.sums[1:])
        self.inverse = _power(1, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, length: int) -> np.ndarray:
        """Of every substring of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length * 0xD6E8FEB86659FD93 & _MASK))


# --- links and components ---------------------------------------------------------------------------------------


class Union:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in edges (a, b), component_id the smallest id it reaches.

    Alternating large-star and small-star rounds, each a minimum per node and a join, written to the shared folder;
    the rounds needed grow with the logarithm of the longest chain. No links give an empty result.
    """

    def starred(links: DataFrame, large: bool) -> DataFrame:
        ends = links.union(links.select("b", "a")) if large else links
        least = ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        joined = ends.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return out.where("a <> b").distinct()

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialise(links, "links")
    before = state(links)
    while True:
        links = materialise(starred(starred(links, True), False), "links")
        now = state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)
