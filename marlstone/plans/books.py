"""Queries of the ledger, the portfolio and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import ledger, portfolio
from ..sources import merge, scratch, tables
from .bindings import view
from .registry import query

LOTS_SQL = """
fl AS (SELECT * FROM fills WHERE transaction_type = 'Trade' AND symbol IS NOT NULL),
sd AS (SELECT *, starts_with(action, 'Buy') AS is_buy, sum(quantity) OVER (PARTITION BY symbol, starts_with(action, 'Buy') ORDER BY executed_at, id ROWS UNBOUNDED PRECEDING) AS hi FROM fl),
mt AS (SELECT b.symbol, least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity) AS q, b.id AS buy_id, s.id AS sell_id, (least(b.hi, s.hi) - greatest(b.hi - b.quantity, s.hi - s.quantity)) * (s.price - b.price) AS realized
  FROM sd b JOIN sd s ON b.symbol = s.symbol AND b.is_buy AND NOT s.is_buy AND b.hi - b.quantity < s.hi AND s.hi - s.quantity < b.hi),
tt AS (SELECT symbol, coalesce(max(hi) FILTER (WHERE is_buy), 0) AS bought, coalesce(max(hi) FILTER (WHERE NOT is_buy), 0) AS sold, count(*) FILTER (WHERE is_buy) AS buys, count(*) FILTER (WHERE NOT is_buy) AS sells, min(executed_at) AS first_at, max(executed_at) AS last_at FROM sd GROUP BY symbol),
ol AS (SELECT sd.symbol, sum((hi - greatest(hi - quantity, least(bought, sold))) * price) AS cost FROM sd JOIN tt ON sd.symbol = tt.symbol WHERE hi > least(bought, sold) GROUP BY 1),
po AS (SELECT tt.symbol, buys, sells, first_at, last_at, bought - sold AS qty, CASE WHEN bought = sold THEN 0.0 ELSE CAST(ol.cost AS DOUBLE) / CAST(abs(bought - sold) AS DOUBLE) END AS avg_price, CAST(coalesce((SELECT sum(realized) FROM mt WHERE mt.symbol = tt.symbol), 0) AS DOUBLE) AS realized FROM tt LEFT JOIN ol ON ol.symbol = tt.symbol)
"""


def trade_fills(spark, d):
    return ledger.trade_fills(view(spark, d, "fills"))


def positions(spark, d):
    return ledger.positions(trade_fills(spark, d))


def broker(spark, d):
    return tables.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.when(F.col("s_suppkey") % 3 == 0, "Short").otherwise("Long").alias("direction"), (F.col("s_suppkey") % 50).cast("double").alias("quantity"), (F.col("s_acctbal") / 100).alias("cost_basis"))


def thesis_bases(spark, d):
    return view(spark, d, "theses").where("number % 2 = 0").select("thesis", "status", (F.col("balance") / 100).alias("cost_basis"), (F.col("number") % 50).cast("double").alias("shares"))


BROKER_SQL = "br AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * CAST(s_suppkey % 50 AS DOUBLE) AS qty, s_acctbal / 100 AS cost_basis FROM supplier), tb AS (SELECT thesis, status, balance / 100 AS cost_basis, CAST(number % 50 AS DOUBLE) AS shares FROM theses WHERE number % 2 = 0)"

query("flt15_trade_fills", "SELECT id, symbol, action, quantity, CAST(price AS DOUBLE) AS price FROM fills WHERE transaction_type = 'Trade' AND symbol IS NOT NULL")(lambda spark, d: trade_fills(spark, d).select("id", "symbol", "action", "quantity", F.col("price").cast("double").alias("price")))
query("win10_positions", f"WITH {LOTS_SQL} SELECT symbol, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, CAST(qty AS BIGINT) AS qty, avg_price, realized FROM po")(lambda spark, d: positions(spark, d).select("symbol", "buys", "sells", F.col("qty").cast("bigint").alias("qty"), "avg_price", "realized"))
query("jn13_lot_matches", f"WITH {LOTS_SQL} SELECT symbol, buy_id, sell_id, CAST(q AS BIGINT) AS q, CAST(realized AS DOUBLE) AS realized FROM mt")(lambda spark, d: ledger.matches(trade_fills(spark, d)).select("symbol", "buy_id", "sell_id", F.col("q").cast("bigint").alias("q"), F.col("realized").cast("double").alias("realized")))
query("agg21_realized", f"WITH {LOTS_SQL}, sh AS (SELECT symbol, CAST(realized AS DECIMAL(18,2)) AS realized FROM po WHERE abs(realized) >= 0.005) SELECT symbol, CAST(realized AS DOUBLE) AS realized FROM sh UNION ALL SELECT 'TOTAL', CAST(coalesce(sum(realized), 0) AS DOUBLE) FROM sh")(lambda spark, d: ledger.realized_totals(positions(spark, d)))
query("agg22_ledger_extent", "SELECT count(*) AS n, CAST(min(executed_at) AS DATE) AS first_date, CAST(max(executed_at) AS DATE) AS last_date FROM fills")(lambda spark, d: view(spark, d, "fills").agg(F.count("*").alias("n"), F.min("executed_at").cast("date").alias("first_date"), F.max("executed_at").cast("date").alias("last_date")))
query("jn05_reconcile", f"""WITH {LOTS_SQL}, {BROKER_SQL},
f0 AS (SELECT coalesce(po.symbol, br.symbol) AS symbol, CAST(coalesce(po.qty, 0) AS DOUBLE) AS ledger_qty, avg_price, coalesce(br.qty, 0) AS broker_qty, br.cost_basis AS broker_avg, br.symbol IS NOT NULL AS held FROM po FULL OUTER JOIN br ON po.symbol = br.symbol),
f1 AS (SELECT f0.*, coalesce(t.cost_basis) AS thesis_avg, t.shares, t.thesis FROM f0 LEFT JOIN tb t ON t.thesis = f0.symbol WHERE ledger_qty <> 0 OR held)
SELECT symbol, ledger_qty, broker_qty, coalesce(nullif(array_to_string(list_filter([CASE WHEN ledger_qty <> broker_qty THEN 'quantity' END, CASE WHEN ledger_qty <> 0 AND abs(avg_price - broker_avg) > 0.005 THEN 'ledger price' END, CASE WHEN abs(thesis_avg - broker_avg) > 0.005 THEN 'thesis price' END, CASE WHEN abs(shares - abs(broker_qty)) > 1e-9 THEN 'thesis shares' END, CASE WHEN held AND thesis IS NULL THEN 'no thesis' END], lambda x : x IS NOT NULL), '; '), ''), 'OK') AS status FROM f1""")(lambda spark, d: ledger.reconcile(positions(spark, d), broker(spark, d), thesis_bases(spark, d)))
query("jn06_theses_without_position", f"WITH {BROKER_SQL} SELECT thesis FROM tb WHERE status = 'active' AND thesis NOT IN (SELECT symbol FROM br)")(lambda spark, d: ledger.theses_without_position(thesis_bases(spark, d), broker(spark, d)).select("thesis"))
query("top09_positions_by_size", f"WITH {LOTS_SQL} SELECT symbol, qty <> 0 AS open, row_number() OVER (PARTITION BY qty <> 0 ORDER BY abs(CAST(qty AS DOUBLE) * avg_price) DESC, symbol) AS place FROM po")(lambda spark, d: ledger.by_size(positions(spark, d)).select("symbol", "open", "place"))
query("set01_key_sets", f"WITH {BROKER_SQL}, a AS (SELECT symbol FROM br), b AS (SELECT thesis AS symbol FROM tb) SELECT 'both' AS part, count(*) AS n FROM (SELECT symbol FROM a INTERSECT SELECT symbol FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT symbol FROM a UNION SELECT symbol FROM b) UNION ALL SELECT 'left only', count(*) FROM (SELECT symbol FROM a EXCEPT SELECT symbol FROM b)")(
    lambda spark, d: (lambda a, b: a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(a.union(b).distinct().agg(F.lit("any"), F.count("*"))).union(a.exceptAll(b).agg(F.lit("left only"), F.count("*"))))(broker(spark, d).select("symbol"), thesis_bases(spark, d).select("thesis"))
)
query("mrg02_upsert_daily", "WITH n AS (SELECT date, account_number, nlv + 1 AS nlv FROM portfolio_daily WHERE account_number = '2') SELECT * FROM n UNION ALL SELECT date, account_number, nlv FROM portfolio_daily WHERE account_number <> '2'")(lambda spark, d: (lambda p: merge.newer_wins(p, p.where("account_number = '2'").withColumn("nlv", F.col("nlv") + 1), ["date", "account_number"]))(view(spark, d, "portfolio_daily").select("date", "account_number", "nlv")))
query("mrg03_insert_absent", "SELECT id, symbol, quantity FROM fills")(lambda spark, d: (lambda f: merge.insert_absent(f.where("id % 3 > 0"), f.withColumn("quantity", F.when(F.col("id") % 3 > 0, F.col("quantity") + 5).otherwise(F.col("quantity"))), ["id"]))(view(spark, d, "fills").select("id", "symbol", "quantity")))


def synced(spark, d):
    """The fills carried in three batches: each from two days before the last one's end on, the first from inception; ids that are there already are not taken twice."""
    feed = trade_fills(spark, d).select("id", "symbol", "action", "quantity", "price", "executed_at")
    days = feed.agg(F.min(F.to_date("executed_at")).alias("first"), F.max(F.to_date("executed_at")).alias("last")).select("first", F.date_add("first", (F.datediff("last", "first") / 3).cast("int")).alias("a"), F.date_add("first", (F.datediff("last", "first") * 2 / 3).cast("int")).alias("b"), "last").first()
    ledger_rows, lots, made = feed.limit(0), feed.limit(0), None
    for begin, end in ((None, days["a"]), (days["a"], days["b"]), (days["b"], days["last"])):
        since = None if begin is None else F.date_sub(F.lit(begin), 2)
        grown = scratch.written(merge.sync(ledger_rows, feed.where(F.to_date("executed_at") <= F.lit(end)), F.to_date("executed_at"), since), "ledger")
        new = grown.join(ledger_rows.select("id"), "id", "left_anti")
        found, lots = (scratch.written(x, n) for x, n in zip(ledger.carry(lots, new), ("matches", "open-lots"), strict=True))
        ledger_rows, made = grown, found if made is None else made.unionByName(found)
    return ledger_rows, made, lots


query("jn13_carried_matches", f"WITH {LOTS_SQL} SELECT symbol, buy_id, sell_id, CAST(q AS BIGINT) AS q, CAST(realized AS DOUBLE) AS realized FROM mt")(lambda spark, d: synced(spark, d)[1].select("symbol", "buy_id", "sell_id", F.col("q").cast("bigint").alias("q"), F.col("realized").cast("double").alias("realized")))
query("win10_carried_lots", f"WITH {LOTS_SQL} SELECT symbol, CAST(qty AS BIGINT) AS qty FROM po WHERE qty <> 0")(lambda spark, d: synced(spark, d)[2].groupBy("symbol").agg(F.sum(F.when(F.col("action") == "Buy", F.col("quantity")).otherwise(-F.col("quantity"))).cast("bigint").alias("qty")))
query("src18_synced_ledger", "SELECT id, symbol, quantity FROM fills WHERE transaction_type = 'Trade' AND symbol IS NOT NULL")(lambda spark, d: synced(spark, d)[0].select("id", "symbol", "quantity"))
query("mrg06_append_history", "SELECT number, status, bucket FROM theses")(lambda spark, d: (lambda t: merge.append_distinct(t.where("number % 2 = 0"), t))(view(spark, d, "theses").select("number", "status", "bucket")))
query("src18_sync_window", "SELECT id, symbol FROM fills WHERE CAST(executed_at AS DATE) >= (SELECT max(CAST(executed_at AS DATE)) FROM fills) - 7")(lambda spark, d: (lambda f: f.crossJoin(F.broadcast(f.agg(F.max(F.to_date("executed_at")).alias("m")))).where(F.to_date("executed_at") >= F.date_sub("m", 7)).select("id", "symbol"))(view(spark, d, "fills")))

# --- portfolio
PL_SQL = "pp AS (SELECT *, CASE WHEN direction = 'Short' THEN -1 ELSE 1 END * ((mark_price - cost_basis) * quantity * multiplier) AS unrealized_pl, CASE WHEN cost_basis > 0 THEN (mark_price / cost_basis - 1) * 100 END AS unrealized_pl_pct FROM position_daily)"


def daily(spark, d):
    return view(spark, d, "portfolio_daily")


def held(spark, d):
    return view(spark, d, "position_daily")


query("agg26_profit", f"WITH {PL_SQL} SELECT date, account_number, symbol, direction, unrealized_pl, unrealized_pl_pct FROM pp")(lambda spark, d: portfolio.with_profit(held(spark, d)).select("date", "account_number", "symbol", "direction", "unrealized_pl", "unrealized_pl_pct"))
query("jn02_audit", "SELECT q.date, q.account_number, symbol, direction, quantity, p.nlv FROM position_daily q JOIN portfolio_daily p ON q.date = p.date AND q.account_number = p.account_number")(lambda spark, d: portfolio.audit(daily(spark, d), held(spark, d)).select("date", "account_number", "symbol", "direction", "quantity", "nlv"))
query("jn03_latest_positions", "SELECT symbol, direction, quantity FROM position_daily WHERE date = (SELECT max(date) FROM position_daily)")(lambda spark, d: portfolio.latest(held(spark, d)).select("symbol", "direction", "quantity"))
query("jn04_summary", "SELECT date, account_number, nlv, position_count, (SELECT count(*) FROM position_daily q WHERE q.date = p.date) AS total_positions FROM portfolio_daily p WHERE date = (SELECT max(date) FROM portfolio_daily)")(lambda spark, d: portfolio.summary(daily(spark, d), held(spark, d)))
query("jn08_value_change", "WITH l AS (SELECT max(date) AS e FROM portfolio_daily), n AS (SELECT nlv, date FROM portfolio_daily, l WHERE date = e ORDER BY account_number DESC LIMIT 1), t AS (SELECT nlv, date FROM portfolio_daily, l WHERE date <= e - 30 ORDER BY date DESC, account_number DESC LIMIT 1) SELECT n.date AS \"end\", n.nlv AS now, t.date AS start, t.nlv AS \"then\", n.nlv - t.nlv AS change FROM n, t")(lambda spark, d: portfolio.change_since(daily(spark, d), 30))
query("jn08_as_of", "SELECT b.ticker, b.date, (SELECT arg_max(c.close, c.date) FROM bars c WHERE c.ticker = b.ticker AND c.date <= b.date AND day(c.date) <= 5) AS close FROM bars b WHERE day(b.date) = 28")(lambda spark, d: (lambda b: portfolio.as_of(b.where("day(date) = 28").select("ticker", "date"), b.where("day(date) <= 5"), "ticker", "close"))(view(spark, d, "bars")))
query("jn14_latest_close", "SELECT t.thesis AS ticker, coalesce(CASE WHEN number % 7 = 0 THEN balance END, (SELECT arg_max(close, date) FROM bars WHERE ticker = CASE number % 4 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BD' WHEN 2 THEN 'EW' END)) AS price FROM theses t")(
    lambda spark, d: (lambda t, p: t.join(p, "ticker", "left").select(F.col("thesis").alias("ticker"), F.coalesce("override", "price").alias("price")))(
        view(spark, d, "theses").select("thesis", F.when(F.col("number") % 7 == 0, F.col("balance")).alias("override"), F.element_at(F.array(F.lit("EQ"), F.lit("BD"), F.lit("EW"), F.lit("none")), (F.col("number") % 4 + 1).cast("int")).alias("ticker")),
        view(spark, d, "bars").groupBy("ticker").agg(F.max_by("close", "date").alias("price")),
    )
)
query("top05_newest_values", "SELECT date, account_number, nlv FROM portfolio_daily ORDER BY date DESC, account_number LIMIT 30")(lambda spark, d: portfolio.newest(daily(spark, d), 30).select("date", "account_number", "nlv"))
query("top05_newest_per_account", "SELECT date, account_number, nlv FROM (SELECT *, row_number() OVER (PARTITION BY account_number ORDER BY date DESC) AS k FROM portfolio_daily) WHERE k <= 10")(lambda spark, d: portfolio.newest_per_account(daily(spark, d), 10).select("date", "account_number", "nlv"))
query("top06_positions_by_value", f"WITH {PL_SQL} SELECT symbol, direction, unrealized_pl, row_number() OVER (ORDER BY quantity * mark_price DESC, symbol, account_number, direction) AS place FROM pp WHERE date = (SELECT max(date) FROM position_daily)")(lambda spark, d: portfolio.by_value(held(spark, d)).select("symbol", "direction", "unrealized_pl", "place"))
query("top06_symbol_history", "SELECT date, account_number, quantity FROM position_daily WHERE symbol = '7'")(lambda spark, d: spark.sql("SELECT date, account_number, quantity FROM {p} WHERE symbol = :symbol", args={"symbol": "7"}, p=held(spark, d)))
#: What a user may ask of the tables, by name.
QUESTIONS = [
    "SELECT account_number, CAST(count(*) AS DOUBLE) AS value FROM portfolio_daily WHERE nlv > 200000 GROUP BY account_number",
    "WITH p AS (SELECT account_number, max(date) AS last FROM position_daily GROUP BY account_number) SELECT p.account_number, max(nlv) AS value FROM p JOIN portfolio_daily d ON d.account_number = p.account_number AND d.date = p.last GROUP BY p.account_number",
]


def answers(spark, d):
    tables_ = {"portfolio_daily": daily(spark, d), "position_daily": view(spark, d, "position_daily")}
    first, second = (portfolio.ask(spark, q, tables_).select(F.lit(n).alias("question"), "account_number", "value") for n, q in enumerate(QUESTIONS))
    return first.unionByName(second)


query("top07_user_statements", f"SELECT 0 AS question, * FROM ({QUESTIONS[0]}) a UNION ALL SELECT 1, * FROM ({QUESTIONS[1]}) b /* portfolio_daily position_daily */")(answers)
query("top07_any_sql", "SELECT account_number, count(*) AS days, max(nlv) AS best FROM portfolio_daily GROUP BY account_number")(lambda spark, d: spark.sql("SELECT account_number, count(*) AS days, max(nlv) AS best FROM {p} GROUP BY account_number", p=daily(spark, d)))
query("src16_snapshot_accounts", "WITH c AS (SELECT date, account_number, count(*) AS n FROM position_daily GROUP BY 1, 2) SELECT p.date, p.account_number, p.nlv, CAST(coalesce(n, 0) AS INT) AS position_count FROM portfolio_daily p LEFT JOIN c ON p.date = c.date AND p.account_number = c.account_number")(lambda spark, d: portfolio.read_snapshots(portfolio.snapshot_lines(daily(spark, d), held(spark, d)))[0].select("date", "account_number", "nlv", "position_count"))
query("src17_snapshot_positions", "SELECT q.date, q.account_number, symbol, direction, quantity, mark_price FROM position_daily q JOIN portfolio_daily p ON q.date = p.date AND q.account_number = p.account_number")(lambda spark, d: portfolio.read_snapshots(portfolio.snapshot_lines(daily(spark, d), held(spark, d)))[1].select("date", "account_number", "symbol", "direction", "quantity", "mark_price"))
query("src26_one_per_symbol", "SELECT date, symbol, account_number, quantity FROM (SELECT *, row_number() OVER (PARTITION BY date, symbol ORDER BY account_number DESC, direction DESC) AS k FROM position_daily) WHERE k = 1")(lambda spark, d: portfolio.one_per_symbol(held(spark, d)).select("date", "symbol", "account_number", "quantity"))
query("jn11_enriched_rows", "SELECT thesis, number, balance AS price, CASE WHEN balance > 0 THEN floor((balance / (number + 1) - 1) * 1e6 + 0.5) / 1e6 END AS move FROM theses")(lambda spark, d: view(spark, d, "theses").select("thesis", "number", F.col("balance").alias("price"), F.when(F.col("balance") > 0, r6(F.col("balance") / (F.col("number") + 1) - 1)).alias("move")))
