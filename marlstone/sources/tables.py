"""Readers and parsers of delimited and JSON text, each over a column so that any text source can feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import us_or_iso_date

BAR = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key: a file of one row group is read by one task, and what costs much a row should have many."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar files with a header, one per ticker; the ticker is the file's name. Malformed lines give NULLs."""
    raw = spark.read.schema(BAR.split(", ", 1)[1]).csv(path, header=True)
    return raw.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)).select("ticker", *raw.columns)


def write_bars(bars: DataFrame, path: str) -> None:
    """Replaces the files of the tickers in bars: CSV with a header, a folder each."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").csv(path, header=True)


def read_written_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR.split(", ", 1)[1] + ", ticker string").csv(path, header=True).select("ticker", *(c.split()[0] for c in BAR.split(", ")[1:]))


def bar_lines(bars: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in BAR.split(", ")]
    return bars.select(F.to_csv(F.struct(*columns)).alias("line"))


def parse_bars(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_csv("line", BAR).alias("r")).select("r.*")


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def candidates_from_json(lines: DataFrame) -> DataFrame:
    """Candidates without a ticker drop out; numbers may be text; a missing sector is Unknown."""
    fields = ("pe", "pfcf", "roe", "roic", "op_margin", "profit_margin", "de", "insider_pct")
    r = lines.select(F.from_json("line", "ticker string, company string, sector string, " + ", ".join(f"{f} string" for f in fields)).alias("r")).select("r.*")
    r = r.withColumns({f: F.col(f).try_cast("double") for f in fields} | {"sector": F.coalesce("sector", F.lit("Unknown"))})
    return r.where("ticker IS NOT NULL AND ticker <> ''")


def curve(bars: DataFrame) -> DataFrame:
    """A yield curve as published: US dates as text, one text column per tenor, blanks where there is no rate."""
    rate = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return bars.select(F.date_format("date", "MM/dd/yyyy").alias("Date"), rate(F.when(F.dayofmonth("date") % 3 > 0, F.col("low"))).alias("3 Mo"), rate(F.col("high")).alias("1 Yr"))


def long_curve(wide: DataFrame) -> DataFrame:
    """date, tenor, rate; rows whose date or rate can't be read drop out."""
    tenors = [c for c in wide.columns if c != "Date"]
    long = wide.unpivot("Date", tenors, "tenor", "rate")
    return long.select(us_or_iso_date(F.col("Date")).alias("date"), "tenor", F.col("rate").try_cast("double").alias("rate")).where("date IS NOT NULL AND rate IS NOT NULL")


def tenor(long: DataFrame, name: str) -> DataFrame:
    return long.where(F.col("tenor") == name)


def latest_yields(wide: DataFrame) -> DataFrame:
    return long_curve(wide).groupBy("tenor").agg(F.max("date").alias("date"), F.max_by("rate", "date").alias("rate"))


def two_styles(bars: DataFrame) -> DataFrame:
    """Dates written in two styles and read again."""
    text = F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "MM/dd/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    return bars.select(us_or_iso_date(text).alias("date")).distinct()
