"""Merges, upserts and deduplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newer_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows by key, new over old. Of several rows of a key on one side that with the largest other columns, from the first to the last, stays (NULL is the least)."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rest = [F.desc_nulls_last(c) for c in old.columns if c not in key]
    w = Window.partitionBy(*key).orderBy("_age", *rest)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_age", "_k")


def last_write_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there; the first write stays."""
    return old.unionByName(new.join(old, key, "left_anti"))


def sync(ledger: DataFrame, feed: DataFrame, day: Column, since: Column | None) -> DataFrame:
    """The ledger with the rows of a feed from the day `since` on, or from inception where that is None or NULL, whose id it has not; of repeated ids of a feed the least row is taken."""
    recent = feed if since is None else feed.where(since.isNull() | (day >= since))
    rest = [c for c in feed.columns if c != "id"]
    recent = last_write_wins(recent, ["id"], [F.asc_nulls_last(c) for c in rest])
    return insert_absent(ledger, recent.select(ledger.columns), ["id"])


def append_distinct(history: DataFrame, entries: DataFrame) -> DataFrame:
    """History, and the entries that no row of it equals."""
    cond = None
    h = history.select(*(F.col(c).alias(f"_{c}") for c in history.columns))
    for c in history.columns:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        cond = same if cond is None else cond & same
    return history.unionByName(entries.distinct().join(h, cond, "left_anti"))


def staleness(bars: DataFrame, today: Column, days: int) -> DataFrame:
    """Last date of each ticker, and whether it is more than days before today."""
    return bars.groupBy("ticker").agg(F.max("date").alias("last_date")).withColumn("stale", F.datediff(today, "last_date") > days)


def top_per_form(filings: DataFrame, wanted: dict[str, int], window_days: int, asof: Column) -> DataFrame:
    """The newest filings: so many of each wanted form, and all of the last window_days, each once, newest first."""
    w = Window.partitionBy("ticker", "form").orderBy(F.desc("filed"), F.desc("accession"))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in wanted.items() for x in p]), F.col("form")), F.lit(0))
    n = filings.withColumn("_k", F.row_number().over(w))
    kept = n.where((F.col("_k") <= limit) | (F.datediff(asof, "filed") <= window_days))
    return last_write_wins(kept.drop("_k"), ["ticker", "accession"], ["filed"])
