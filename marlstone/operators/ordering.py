"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(rows: DataFrame, name: str, by: Column, then: Sequence[Column], group: str | None = None, ranges: int = 64) -> DataFrame:
    """rows with their number from 1, in ascending order of by, a number that isn't NULL, and of what is to follow it; of each group if there is one (a flag or alike).

    Rows are cut into ranges at quantiles of by, numbered within them, and moved by the rows of the ranges before. Rows of one value of by share a range.
    """
    keyed = rows.withColumn("_by", by.cast("double"))
    cuts = keyed.agg(F.coalesce(F.percentile_approx("_by", [i / ranges for i in range(1, ranges)], 1000), F.array().cast("array<double>")).alias("_cuts"))
    keyed = keyed.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_by")))).drop("_cuts")  # cuts: one row
    keys = [group] if group else []
    counts = keyed.groupBy(*keys, "_range").agg(F.count("*").alias("n"))
    counts = counts.groupBy(*(F.col(g).alias("_group") for g in keys)).agg(F.collect_list(F.struct("_range", "n")).alias("_counts"))  # as many as ranges
    # What is before a range is told on its own: rows that carried all counts would be sorted with them.
    before = F.aggregate(F.filter("_counts", lambda c: c["_range"] < F.col("_c")["_range"]), F.lit(0).cast("long"), lambda t, c: t + c["n"])
    starts = counts.select("*", F.explode("_counts").alias("_c")).select(*(["_group"] if group else []), F.col("_c")["_range"].alias("_at"), before.alias("_before"))
    same = (F.col("_range") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")) if group else F.col("_range") == F.col("_at")
    placed = keyed.join(F.broadcast(starts), same)  # a row for each group and range
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_by", *then))
    return placed.withColumn(name, (F.col("_before") + within).cast("int")).drop("_by", "_range", "_at", "_before", "_group")
