"""Portfolio snapshots and reports in SQL and DataFrame form."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT = "date date, accounts array<struct<account_number string, nlv double, positions array<struct<symbol string, direction string, quantity double, mark_price double, cost_basis double, multiplier double, realized_day_pl double>>>>"


def with_profit(positions: DataFrame) -> DataFrame:
    """Unrealized profit (sign turned for shorts) and its percentage (not turned)."""
    gain = (F.col("mark_price") - F.col("cost_basis")) * F.col("quantity") * F.col("multiplier")
    return positions.withColumns({"unrealized_pl": F.when(F.col("direction") == "Short", -gain).otherwise(gain), "unrealized_pl_pct": F.when(F.col("cost_basis") > 0, (F.col("mark_price") / F.col("cost_basis") - 1) * 100)})


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the last date: a cross join with a one-row aggregate."""
    last = rows.agg(F.max("date").alias("max_date"))
    return rows.crossJoin(F.broadcast(last)).where("date = max_date").drop("max_date")  # last: one row


def summary(daily: DataFrame, positions: DataFrame) -> DataFrame:
    """The last day of each account, with how many positions there are on that day."""
    return daily.sparkSession.sql(
        """WITH latest AS (SELECT max(date) AS max_date FROM {daily})
        SELECT p.date, p.account_number, p.nlv, p.position_count, (SELECT count(*) FROM {positions} q WHERE q.date = p.date) AS total_positions
        FROM {daily} p, latest WHERE p.date = latest.max_date""",
        daily=daily, positions=positions,
    )


def audit(daily: DataFrame, positions: DataFrame) -> DataFrame:
    return positions.join(daily.select("date", "account_number", "nlv"), ["date", "account_number"])


def by_value(positions: DataFrame) -> DataFrame:
    p = with_profit(latest(positions)).withColumn("market_value", F.col("quantity") * F.col("mark_price"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("market_value"), "symbol", "account_number", "direction")))


def newest(daily: DataFrame, rows: int) -> DataFrame:
    """The last rows of the report; the number counts rows, whatever their account."""
    return daily.orderBy(F.desc("date"), "account_number").limit(rows)


def newest_per_account(daily: DataFrame, rows: int) -> DataFrame:
    w = Window.partitionBy("account_number").orderBy(F.desc("date"))
    return daily.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows).drop("_k")


def change_since(daily: DataFrame, days: int) -> DataFrame:
    """Last value against the last one on or before `days` earlier; accounts are not told apart."""
    order = F.struct("date", "account_number")
    last = daily.agg(F.max("date").alias("end"), F.max_by("nlv", order).alias("now"))
    before = daily.crossJoin(F.broadcast(last)).where(F.col("date") <= F.date_sub("end", days))  # last: one row
    return before.groupBy("end", "now").agg(F.max("date").alias("start"), F.max_by("nlv", order).alias("then")).withColumn("change", F.col("now") - F.col("then"))


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """For each row of left the last value of right at or before its date, by key: one sort, no join of pairs."""
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, "date", F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def snapshot_lines(daily: DataFrame, positions: DataFrame) -> DataFrame:
    """One JSON document per day, as a broker's export has it."""
    p = positions.groupBy("date", "account_number").agg(F.collect_list(F.struct("symbol", "direction", "quantity", "mark_price", "cost_basis", "multiplier")).alias("positions"))
    a = daily.select("date", "account_number", "nlv").join(p, ["date", "account_number"], "left").groupBy("date").agg(F.collect_list(F.struct("account_number", "nlv", "positions")).alias("accounts"))
    return a.select(F.to_json(F.struct("date", "accounts")).alias("line"))


def read_snapshots(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account rows, position rows) of snapshot documents; profits that are missing count as 0."""
    s = lines.select(F.from_json("line", SNAPSHOT).alias("s")).select("s.*").select("date", F.explode("accounts").alias("a"))
    unrealized = F.transform("positions", lambda p: F.when(p["direction"] == "Short", -1.0).otherwise(1.0) * (p["mark_price"] - p["cost_basis"]) * p["quantity"] * p["multiplier"])
    total = F.aggregate(F.coalesce(unrealized, F.array().cast("array<double>")), F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    realized = F.aggregate(F.coalesce(F.transform("positions", lambda p: p["realized_day_pl"]), F.array().cast("array<double>")), F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    rows = s.select("date", "a.*")
    accounts = rows.select("date", "account_number", "nlv", F.size(F.coalesce("positions", F.array())).alias("position_count"), total.alias("daily_pl_unrealized"), realized.alias("daily_pl_realized"), (total + realized).alias("daily_pl"))
    return accounts, rows.select("date", "account_number", F.explode("positions").alias("p")).select("date", "account_number", "p.*")


def one_per_symbol(positions: DataFrame) -> DataFrame:
    """One row per symbol of a snapshot: the last account's."""
    w = Window.partitionBy("date", "symbol").orderBy(F.desc("account_number"), F.desc("direction"))
    return positions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ask(spark: SparkSession, statement: str, tables: dict[str, DataFrame], args: dict[str, object] | None = None) -> DataFrame:
    """The rows of a user's query over tables by name, with values for its :parameters. Only queries are taken, no commands."""
    rest = re.sub(r"(?s)\A(?:\s|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", "", statement).rstrip().rstrip(";")  # remarks before it
    words = rest.lstrip(" \t\r\n(").split(None, 1)
    if not words or words[0].upper() not in ("SELECT", "WITH", "VALUES", "FROM"):
        raise ValueError("only queries can be asked")
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, table in tables.items():
        table.createOrReplaceTempView(views[name])
    # Names become views of their own, so questions side by side don't see each other's tables.
    ctes = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    head = re.match(r"(?is)with\s+(recursive\s+)?", rest)
    text = f"WITH {head[1] or ''}{ctes}, {rest[head.end():]}" if head else f"WITH {ctes} {rest}"
    return spark.sql(text if ctes else rest, args=args or {})
