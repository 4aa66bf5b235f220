"""Running values along series of any length, without a task that holds a whole series.

A series is cut into chunks of consecutive rows. Windows run within chunks; what comes before a chunk is carried in as the totals of the chunks before, one row each, and windows
of bounded reach see a halo, the last rows of the chunk before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk, and days whose rows are counted together before rows have numbers.
CHUNK, DAYS = 1024, 366


def numbered(rows: DataFrame, key: Sequence[str], date: str = "date", name: str = "i", days: int = DAYS) -> DataFrame:
    """rows with their position in their series, from 0, in the order of date, which no two rows of a series share."""
    rows = rows.withColumn("_span", F.floor(F.unix_date(date) / days))
    counts = rows.groupBy(*key, "_span").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*key, "_span").orderBy(date)) - 1
    return rows.join(counts, [*key, "_span"]).withColumn(name, within + F.col("_before")).drop("_span", "_before")


def chunked(rows: DataFrame, halo: int = 0, size: int = CHUNK, i: str = "i") -> DataFrame:
    """rows by chunk, those that are also the next chunk's halo once more: columns chunk, and inside (false in the halo)."""
    size = max(size, halo, 1)
    chunk = F.expr(f"{i} div {size}")
    if not halo:
        return rows.withColumns({"chunk": chunk, "inside": F.lit(True)})
    own, ahead = (F.struct((chunk + n).alias("chunk"), F.lit(n == 0).alias("inside")) for n in (0, 1))
    places = F.when(F.col(i) % size >= size - halo, F.array(own, ahead)).otherwise(F.array(own))
    return rows.withColumn("_place", F.explode(places)).withColumns({"chunk": F.col("_place.chunk"), "inside": F.col("_place.inside")}).drop("_place")


def in_chunk(key: Sequence[str], i: str = "i") -> Window:
    return Window.partitionBy(*key, "chunk").orderBy(i)


def running(rows: DataFrame, key: Sequence[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, i: str = "i") -> DataFrame:
    """rows (with chunk, without halo) with running sums and maxima in the order of i, the row itself included."""
    sums, maxima = sums or {}, maxima or {}
    totals = rows.groupBy(*key, "chunk").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_{n}") for n, c in maxima.items()))
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*key, "chunk", *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums), *(F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in maxima))
    upto = in_chunk(key, i).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, [*key, "chunk"])
    out = out.withColumns({n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.sum(c).over(upto) for n, c in sums.items()} | {n: F.greatest(f"_{n}", F.max(c).over(upto)) for n, c in maxima.items()})
    return out.drop(*(f"_{n}" for n in [*sums, *maxima]))
