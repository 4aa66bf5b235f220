"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

Rows (key, byte digest, rank of the row) are written to the shared folder. The directory starts with a few buckets and doubles as long as one holds more than
`capacity` rows: only the rows of such buckets are read again and split on the next bits of the key. A bucket whose rows all have one key can't split and stays chained.
Buckets are ranges of keys. The index has an entry for each distinct text, with the number of its copies and the row that stays; equality is that of
the normalised bytes, which are grouping keys and combine before the shuffle, so a hot text costs one row per task. Owner tasks take ranges
of buckets: each lays out its part of the index by bucket and key, and entries of one key with other bytes form a chain, numbered by it. Rows are then
looked up in the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, materialise


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def split_buckets(rows: DataFrame, depth: int, capacity: int, step: int = 4) -> list[tuple[int, int]]:
    """(prefix, local depth) of the buckets of rows (h), in order of keys: ranges of keys of at most capacity rows, unless they have one key or `depth` bits."""
    done, open_buckets, local = [], None, 0
    while local < depth and open_buckets != []:
        below, local = local, min(local + step, depth)
        prefix = F.shiftrightunsigned("h", 64 - local).cast("int")
        some = rows if open_buckets is None else rows.where(F.shiftrightunsigned("h", 64 - below).cast("int").isin(open_buckets))
        found = some.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("one")).collect()  # 2**step for each overfull bucket
        counts = {r["p"]: r["n"] for r in found}
        full = sorted(r["p"] for r in found if r["n"] > capacity and not r["one"] and local < depth)
        parents = [0] if open_buckets is None else open_buckets
        for parent in parents:
            done += _halved({p: n for p, n in counts.items() if p >> (local - below) == parent}, parent, below, local, capacity, set(full))
        open_buckets = full
    return sorted(done, key=lambda b: b[0] << (depth - b[1]))


def _halved(counts: dict[int, int], prefix: int, local: int, deepest: int, capacity: int, full: set[int]) -> list[tuple[int, int]]:
    """A bucket split in halves, down to those that fit or are as deep as the counts; of the latter the overfull are left to the next round."""
    inside = sum(n for p, n in counts.items() if p >> (deepest - local) == prefix)
    if local == deepest:
        return [] if prefix in full else [(prefix, local)]
    if inside <= capacity:
        return [(prefix, local)]
    return [b for half in (2 * prefix, 2 * prefix + 1) for b in _halved(counts, half, local + 1, deepest, capacity, full)]


def directory(buckets: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """The global depth, and (slot, bucket, local depth) of every slot of the directory; a bucket is known by its first slot."""
    depth = max((d for _, d in buckets), default=0)
    return depth, [(slot, prefix << (depth - local), local) for prefix, local in buckets for slot in range(prefix << (depth - local), (prefix + 1) << (depth - local))]


def exact_dedup(docs: DataFrame, key: Column | None = None, depth: int = 18, capacity: int = 50_000, row: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, row.

    Of rows whose normalised texts are equal, the one with the most code points in the original text stays, then the
    smallest doc_id (a null doc_id comes last). Null text counts as empty; empty texts equal one another. Very long texts are compared whole. A repeated
    doc_id: rows are ranked as any others; of fully equal rows one stays (kept is true for just one). Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    key: the hash of the column `norm` used as the key (for tests); it may collide, since bytes are compared: chain is the place among the texts of one key, from 0.
    depth: the directory's most bits, so its most rows; row: the number by which a row is known, another for each; by default they are numbered here.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.monotonically_increasing_id() if row is None else row).alias("row")).withColumn("norm", normalised(F.col("text")))
    base = base.withColumn("h", F.xxhash64("norm") if key is None else key)
    rows = materialise(base.select("doc_id", F.length("text").alias("n_cp"), "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "row"), "rows")
    bits, slots = directory(split_buckets(rows, depth, capacity))
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("slot", "bucket", "local_depth")])
    slot = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    slots = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0)], schema))  # at most 2**depth rows
    # The bytes are compared here.
    texts = base.select("h", "norm").groupBy("h", "norm").agg(F.count("*").alias("group_size"))
    texts = texts.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size")
    rank = F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    best = rows.groupBy("h", "text_sha256").agg(F.min(rank).alias("best"))
    entries = texts.join(best, ["h", "text_sha256"]).withColumn("slot", slot).join(slots, "slot")
    # Owners: ranges of buckets, each laid out by bucket and key.
    owned = entries.repartitionByRange("bucket").withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1)
    index = materialise(owned.select("bucket", "h", "text_sha256", "chain", "group_size", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_row")), "index")
    found = rows.join(index, ["h", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket", "chain", "row")
