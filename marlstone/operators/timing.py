"""Totals of timed stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_totals(records: DataFrame) -> DataFrame:
    """Per run and stage (run, stage, seconds): how often, total, longest, and its share of the run; a stage without seconds failed and counts as such."""
    by = records.groupBy("run", "stage").agg(F.count("seconds").alias("n"), F.count_if(F.col("seconds").isNull()).alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("total"), F.max("seconds").alias("longest"))
    whole = by.groupBy("run").agg(F.sum("total").alias("whole"))
    return by.join(whole, "run").withColumn("share", F.try_divide(F.col("total").cast("double"), F.col("whole").cast("double"))).drop("whole")
