"""First-in-first-out lots, positions and reconciliation, as windows and joins.

In FIFO the k-th unit bought always pairs with the k-th unit sold of a symbol, whichever came first; that covers short positions and flips. Buys and sells
are laid on one axis of cumulative quantity; between two neighbouring boundaries exactly one buy and one sell apply, so two
windows over the boundaries find all matches without joining fills to fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_numbers


def trade_fills(transactions: DataFrame) -> DataFrame:
    return transactions.where("transaction_type = 'Trade' AND symbol IS NOT NULL")


def lot_intervals(fills: DataFrame) -> DataFrame:
    """symbol, q, buy and sell (structs of price, id, executed_at; NULL where a unit is still open).

    An action that starts with Buy is a buy, any other, NULL included, a sell. Quantities should be exact (integers or decimals).
    """
    side = F.coalesce(F.col("action").startswith("Buy"), F.lit(False))
    w = Window.partitionBy("symbol", "is_buy").orderBy("executed_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    f = fills.where("quantity > 0").withColumn("is_buy", side).withColumn("x", F.sum("quantity").over(w))
    lot = F.struct("price", "id", "executed_at")
    marks = f.groupBy("symbol", "x").agg(F.max(F.when(F.col("is_buy"), lot)).alias("b"), F.max(F.when(~F.col("is_buy"), lot)).alias("s"))
    back = Window.partitionBy("symbol").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("symbol").orderBy("x")), F.lit(0))
    return marks.select("symbol", q.alias("q"), F.last("b", ignorenulls=True).over(back).alias("buy"), F.last("s", ignorenulls=True).over(back).alias("sell"))


def matches(fills: DataFrame) -> DataFrame:
    m = lot_intervals(fills).where("buy IS NOT NULL AND sell IS NOT NULL")
    return m.select("symbol", "q", F.col("buy.id").alias("buy_id"), F.col("sell.id").alias("sell_id"), (F.col("q") * (F.col("sell.price") - F.col("buy.price"))).alias("realized"))


def open_lots(fills: DataFrame) -> DataFrame:
    """What is left of each fill that is not matched yet, as fills: id, symbol, action, quantity, price, executed_at."""
    i = lot_intervals(fills).where("buy IS NULL OR sell IS NULL")
    lot = F.coalesce("buy", "sell")
    action = F.when(F.col("buy").isNotNull(), "Buy").otherwise("Sell")
    left = i.groupBy("symbol", lot["id"].alias("id"), action.alias("action"), lot["price"].alias("price"), lot["executed_at"].alias("executed_at")).agg(F.sum("q").alias("quantity"))
    return left.select("id", "symbol", "action", "quantity", "price", "executed_at")


def carry(lots: DataFrame, fills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches that new fills make with the open lots and with each other, and the lots that are open then.

    New fills come after all earlier ones by (executed_at, id). A pair of fills is matched when the later one comes, all of it, so the matches of any
    batches of fills in that order are those of one run. Work grows with the open lots and the new fills, not with the ledger.
    """
    columns = ["id", "symbol", "action", "quantity", "price", "executed_at"]
    touched = lots.join(fills.select("symbol").distinct(), "symbol", "left_semi")
    both = touched.select(columns).unionByName(fills.select(columns))
    rest = lots.join(fills.select("symbol").distinct(), "symbol", "left_anti")
    return matches(both), open_lots(both).select(lots.columns).unionByName(rest)


def positions(fills: DataFrame) -> DataFrame:
    """Per symbol: net quantity, average open price (0 when flat), realized profit, fills of either side, first and last time."""
    i = lot_intervals(fills)
    open_buy, open_sell = F.col("sell").isNull(), F.col("buy").isNull()
    price = F.when(open_buy, F.col("buy.price")).when(open_sell, F.col("sell.price"))
    lots = i.groupBy("symbol").agg(
        F.sum(F.when(open_buy, F.col("q")).when(open_sell, -F.col("q")).otherwise(0)).alias("qty"),
        F.sum(F.col("q") * price).alias("cost"),
        F.coalesce(F.sum(F.col("q") * (F.col("sell.price") - F.col("buy.price"))), F.lit(0)).cast("double").alias("realized"),
    )
    buy = F.coalesce(F.col("action").startswith("Buy"), F.lit(False))
    counts = fills.groupBy("symbol").agg(F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), F.min("executed_at").alias("first_at"), F.max("executed_at").alias("last_at"))
    avg = F.coalesce(F.try_divide(F.col("cost").cast("double"), F.abs("qty").cast("double")), F.lit(0.0))
    return counts.join(lots.select("symbol", "qty", F.when(F.col("qty") == 0, 0.0).otherwise(avg).alias("avg_price"), "realized"), "symbol")


def realized_totals(pos: DataFrame, hide_below: float = 0.005) -> DataFrame:
    """Realized profit by symbol and in all (symbol TOTAL), near-zero symbols left out of both."""
    shown = pos.where(F.abs("realized") >= hide_below).select("symbol", F.col("realized").cast("decimal(18,2)").alias("realized"))
    total = shown.agg(F.lit("TOTAL").alias("symbol"), F.coalesce(F.sum("realized"), F.lit(0)).alias("realized"))
    return shown.union(total).select("symbol", F.col("realized").cast("double").alias("realized"))


def reconcile(pos: DataFrame, broker: DataFrame, theses: DataFrame) -> DataFrame:
    """Ledger against broker against theses, one row per symbol of the first two, with what disagrees.

    A thesis is looked up by the symbol without its last digits, then by the symbol as it is.
    """
    b = broker.select(F.col("symbol").alias("s2"), (F.col("quantity") * F.when(F.col("direction") == "Long", 1).otherwise(-1)).cast("double").alias("broker_qty"), F.col("cost_basis").alias("broker_avg"))
    j = pos.select("symbol", F.col("qty").cast("double").alias("ledger_qty"), "avg_price").join(b, F.col("symbol") == F.col("s2"), "full_outer")
    j = j.withColumn("symbol", F.coalesce("symbol", "s2")).withColumn("ledger_qty", F.coalesce("ledger_qty", F.lit(0.0)))
    j = j.where((F.col("ledger_qty") != 0) | F.col("s2").isNotNull())
    t = theses.select(F.upper("thesis").alias("key"), "cost_basis", "shares")
    one, two = (t.select(*(F.col(c).alias(c + n) for c in t.columns)) for n in "12")
    j = j.join(one, F.upper(F.regexp_replace("symbol", r"[0-9]+$", "")) == F.col("key1"), "left").join(two, F.upper("symbol") == F.col("key2"), "left")
    has = F.col("key1").isNotNull()
    j = j.withColumns({"thesis_avg": F.when(has, F.col("cost_basis1")).otherwise(F.col("cost_basis2")), "thesis_shares": F.when(has, F.col("shares1")).otherwise(F.col("shares2")), "has_thesis": has | F.col("key2").isNotNull()})
    held = F.coalesce("broker_qty", F.lit(0.0))
    ledger_avg = F.when(F.col("ledger_qty") != 0, F.col("avg_price"))
    flags = F.array_compact(
        F.array(
            F.when(F.col("ledger_qty") != held, F.lit("quantity")),
            F.when(F.abs(ledger_avg - F.col("broker_avg")) > 0.005, F.lit("ledger price")),
            F.when(F.abs(F.col("thesis_avg") - F.col("broker_avg")) > 0.005, F.lit("thesis price")),
            F.when(F.abs(F.col("thesis_shares") - F.abs(held)) > 1e-9, F.lit("thesis shares")),
            F.when(F.col("s2").isNotNull() & ~F.col("has_thesis"), F.lit("no thesis")),
        )
    )
    return j.select("symbol", "ledger_qty", held.alias("broker_qty"), F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, "; ")).alias("status"))


def theses_without_position(theses: DataFrame, broker: DataFrame) -> DataFrame:
    return theses.where("status = 'active'").join(broker.select(F.col("symbol").alias("thesis")), "thesis", "left_anti")


def by_size(pos: DataFrame) -> DataFrame:
    """Open positions by value, largest first, and closed ones apart, numbered."""
    value = F.abs(F.col("qty").cast("double") * F.col("avg_price"))
    is_open = F.col("qty") != 0
    return row_numbers(pos.withColumn("open", is_open).withColumn("value", value), "place", -F.col("value"), [F.col("symbol")], group="open")
