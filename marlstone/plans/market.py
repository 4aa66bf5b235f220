"""Queries of series, back-tests and screening, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import daily_rate, hurdle, r6
from ..operators import backtest, screener, series
from ..sources import merge, scratch, store, tables
from .bindings import view
from .registry import query

RATE = 4.0
MOVE = 0.2  # the stand-in series move far more in a day than markets do
SERIES_SQL = """
r AS (SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 20) OVER w - 1 AS ret_20, close / lag(close, 60) OVER w - 1 AS ret_60,
  close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS drawdown,
  CASE WHEN count(volume) OVER v = 20 THEN CAST(sum(volume) OVER v AS DOUBLE) / 20 END AS volume_avg
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
"""
PANEL_SQL = """
j AS (SELECT e.date, e.close AS eq_close, b.close AS bd_close, e.volume AS eq_volume FROM bars e JOIN bars b ON e.date = b.date AND e.ticker = 'EQ' AND b.ticker = 'BD'),
p AS (SELECT *, eq_close / lag(eq_close) OVER w - 1 AS eq_ret, bd_close / lag(bd_close) OVER w - 1 AS bd_ret, CASE WHEN count(eq_volume) OVER v = 20 THEN CAST(sum(eq_volume) OVER v AS DOUBLE) / 20 END AS volume_avg,
  row_number() OVER w - 1 AS i, count(*) OVER () AS n
  FROM j WINDOW w AS (ORDER BY date), v AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(eq_ret < -0.2 AND bd_ret > 0.2, false) AS big_blue_day, coalesce(eq_ret < -0.2 AND bd_ret < 0 AND eq_volume > 1.5 * volume_avg, false) AS capitulation FROM p),
g AS (SELECT *, big_blue_day OR capitulation AS combined FROM f)
"""


def bars(spark, d):
    return view(spark, d, "bars")


def flags(spark, d):
    return series.fire_flags(series.panel(bars(spark, d)), MOVE)


query("win16_regime", f"""WITH {SERIES_SQL},
x AS (SELECT e.date, CASE WHEN e.drawdown <= -0.20 THEN 'danger' WHEN e.ret_20 < -0.05 AND b.ret_20 < 0 THEN 'red' WHEN e.ret_20 > 0 AND b.ret_20 > 0 THEN 'green' WHEN e.ret_20 < 0 AND b.ret_20 > 0 THEN 'blue' ELSE 'orange' END AS color,
  e.ret_20 AS eq_ret_short, b.ret_20 AS bd_ret_short, w.ret_60 - e.ret_60 AS breadth_spread, e.drawdown, CASE WHEN w.ret_60 - e.ret_60 < -0.05 THEN 'narrow' ELSE 'broad' END AS breadth,
  e.ret_1 < -0.01 AND b.ret_1 > 0.01 AS big_blue_day, e.ret_1 < -0.01 AND b.ret_1 < 0 AND coalesce(e.volume > 1.5 * e.volume_avg, false) AS capitulation
  FROM r e JOIN r b ON e.date = b.date JOIN r w ON e.date = w.date WHERE e.ticker = 'EQ' AND b.ticker = 'BD' AND w.ticker = 'EW' AND e.ret_60 IS NOT NULL AND b.ret_60 IS NOT NULL AND w.ret_60 IS NOT NULL)
SELECT *, round(4.5 + CASE color WHEN 'green' THEN 4.0 WHEN 'blue' THEN 4.0 WHEN 'orange' THEN 6.0 WHEN 'red' THEN 8.0 ELSE 10.0 END, 2)::DOUBLE AS hurdle_pct FROM x""")(lambda spark, d: series.regimes(bars(spark, d), 4.5))
query("win01_return", f"WITH {SERIES_SQL} SELECT ticker, date, ret_20 AS ret FROM r")(lambda spark, d: series.returns(bars(spark, d), 20).select("ticker", "date", "ret"))
query("win02_daily_return", f"WITH {SERIES_SQL} SELECT ticker, date, ret_1 AS ret FROM r")(lambda spark, d: series.returns(bars(spark, d), 1).select("ticker", "date", "ret"))
query("win03_trailing_volume", f"WITH {SERIES_SQL} SELECT ticker, date, volume_avg FROM r")(lambda spark, d: series.trailing_volume(bars(spark, d)).select("ticker", "date", "volume_avg"))
query("win04_drawdown", f"WITH {SERIES_SQL} SELECT ticker, date, drawdown FROM r")(lambda spark, d: series.drawdown(bars(spark, d)).select("ticker", "date", "drawdown"))
query("win05_buy_and_hold", f"WITH {SERIES_SQL} SELECT ticker, date, floor(sum(ln(1 + coalesce(ret_1, 0))) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) * 1e6 + 0.5) / 1e6 AS log_equity FROM r")(lambda spark, d: series.log_equity(bars(spark, d)).select("ticker", "date", r6(F.col("log_equity")).alias("log_equity")))
query("win06_cash_equity", "SELECT ticker, date, floor(pow(pow(1.04, 1.0 / 252), row_number() OVER (PARTITION BY ticker ORDER BY date)) * 1e6 + 0.5) / 1e6 AS equity FROM bars")(lambda spark, d: series.cash_equity(bars(spark, d), RATE).select("ticker", "date", r6(F.col("equity")).alias("equity")))
query("win07_fire_flags", f"WITH {PANEL_SQL} SELECT date, big_blue_day, capitulation, combined FROM g")(lambda spark, d: flags(spark, d).select("date", "big_blue_day", "capitulation", "combined"))
query("jn01_panel", f"WITH {PANEL_SQL} SELECT date, eq_close, bd_close, eq_volume, eq_ret, bd_ret, volume_avg, i FROM p")(lambda spark, d: series.panel(bars(spark, d)).drop("pair"))
query("flt01_date_slice", "SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")(lambda spark, d: series.date_slice(bars(spark, d), "1997-01-01", "1998-12-31"))
query("src01_bar_lines", "SELECT * FROM bars")(lambda spark, d: tables.parse_bars(tables.bar_lines(bars(spark, d))))
query("src03_stale_series", "SELECT ticker, max(date) AS last_date, max(date) < DATE '2001-09-01' AS stale FROM bars GROUP BY ticker")(lambda spark, d: merge.staleness(bars(spark, d), F.to_date(F.lit("2001-09-02")), 1))


def refreshed(spark, d):
    """A store with one series that ends early, one that is up to date (with other closes, so that it shows which were fetched), and one missing: read through."""
    path = f"{scratch.shared_root(spark)}/marlstone-{spark.sparkContext.applicationId}/bar-store-{uuid.uuid4().hex}"
    source = bars(spark, d)
    store.replace_series(source.where("ticker = 'BD' OR ticker = 'EQ' AND date < DATE '1998-01-01'").withColumn("close", F.col("close") - 1), path)
    last = source.agg(F.max("date").alias("last"))
    today = F.lit(last.first()["last"])
    return store.read_through(spark, path, source.select("ticker").distinct(), lambda stale: source.where("date >= DATE '1997-06-01' OR ticker <> 'EQ'").join(stale, "ticker", "left_semi"), today, 30)


query("src03_read_through", "SELECT ticker, date, CASE WHEN ticker = 'BD' OR ticker = 'EQ' AND date < DATE '1997-06-01' THEN close - 1 ELSE close END AS close, volume FROM bars")(lambda spark, d: refreshed(spark, d).select("ticker", "date", "close", "volume"))
query("src05_back_test_scan", "SELECT date, open, high, low, close, volume FROM bars WHERE ticker = 'EQ'")(lambda spark, d: tables.parse_bars(tables.bar_lines(bars(spark, d).where("ticker = 'EQ'"))).drop("ticker"))
query("src06_curve_latest", "WITH c AS (SELECT date, '3 Mo' AS tenor, CASE WHEN day(date) % 3 > 0 THEN low END AS rate FROM bars WHERE ticker = 'BD' UNION ALL SELECT date, '1 Yr', high FROM bars WHERE ticker = 'BD') SELECT tenor, max(date) AS date, arg_max(rate, date) AS rate FROM c WHERE rate IS NOT NULL GROUP BY tenor")(lambda spark, d: tables.latest_yields(tables.curve(bars(spark, d).where("ticker = 'BD'"))))
query("src07_tenors", "SELECT date, high AS rate FROM bars WHERE ticker = 'BD'")(lambda spark, d: tables.tenor(tables.long_curve(tables.curve(bars(spark, d).where("ticker = 'BD'"))), "1 Yr").select("date", "rate"))
query("src08_dates", "SELECT DISTINCT date FROM bars")(lambda spark, d: tables.two_styles(bars(spark, d)))
query("mrg01_merge_series", "WITH n AS (SELECT ticker, date, open, high, low, close + 1 AS close, volume FROM bars WHERE month(date) = 3) SELECT * FROM n UNION ALL SELECT * FROM bars WHERE month(date) <> 3")(lambda spark, d: merge.newer_wins(bars(spark, d), bars(spark, d).where("month(date) = 3").withColumn("close", F.col("close") + 1), ["ticker", "date"]))
query("mth01_daily_rate", "SELECT n_nationkey, floor((pow(1 + n_nationkey / 100.0, 1.0 / 252) - 1) * 1e9 + 0.5) / 1e9 AS rate FROM nation")(lambda spark, d: tables.read(spark, d, "nation").select("n_nationkey", (F.floor(daily_rate(F.col("n_nationkey").cast("double")) * 1e9 + 0.5) / 1e9).alias("rate")))
query("mth02_hurdle", "SELECT thesis, color, round(4.25 + CASE color WHEN 'green' THEN 4.0 WHEN 'blue' THEN 4.0 WHEN 'orange' THEN 6.0 WHEN 'red' THEN 8.0 WHEN 'danger' THEN 10.0 END, 2)::DOUBLE AS hurdle_pct FROM theses")(lambda spark, d: view(spark, d, "theses").select("thesis", "color", hurdle(F.lit(4.25), F.col("color")).alias("hurdle_pct")))

# --- back-tests
HOLDS = [1, 5, 20]
TRADE_SQL = f"""WITH {PANEL_SQL}, h(hold) AS (VALUES (1), (5), (20)),
s AS (SELECT 'full' AS period, 'combined' AS signal, hold, combined AS fire, g.* FROM g, h UNION ALL SELECT 'full', 'big_blue_day', hold, big_blue_day, g.* FROM g, h UNION ALL SELECT 'full', 'capitulation', hold, capitulation, g.* FROM g, h),
k AS (SELECT *, lag(i) OVER (PARTITION BY signal, hold ORDER BY i) AS before FROM s WHERE fire),
t AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR i - before > hold THEN 1 ELSE 0 END) OVER (PARTITION BY signal, hold ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trade FROM k),
u AS (SELECT period, signal, hold, trade, min(i) AS entry_i, least(max(i) + hold, max(n) - 1) AS exit_i FROM t GROUP BY 1, 2, 3, 4),
tr AS (SELECT u.*, a.date AS entry_date, b.date AS exit_date, a.eq_close AS entry_price, b.eq_close AS exit_price, b.eq_close / a.eq_close - 1 AS trade_return, pow(pow(1.04, 1.0 / 252), exit_i - entry_i) - 1 AS cash_return FROM u JOIN p a ON a.i = entry_i JOIN p b ON b.i = exit_i),
x0 AS (SELECT *, max(CASE WHEN fire THEN i END) OVER (PARTITION BY signal, hold ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_fire FROM s),
x1 AS (SELECT *, coalesce(i - last_fire <= hold, false) AS exposed FROM x0),
x AS (SELECT *, sum(CASE WHEN exposed THEN ln(1 + coalesce(eq_ret, 0)) ELSE ln(1.04) / 252 END) OVER (PARTITION BY signal, hold ORDER BY i ROWS UNBOUNDED PRECEDING) AS log_equity FROM x1),
m0 AS (SELECT *, exp(log_equity - lag(log_equity) OVER (PARTITION BY signal, hold ORDER BY i)) - 1 AS ret, exp(log_equity - max(log_equity) OVER (PARTITION BY signal, hold ORDER BY i ROWS UNBOUNDED PRECEDING)) - 1 AS down FROM x),
m AS (SELECT period, signal, hold, exp((arg_max(log_equity, i) - arg_min(log_equity, i)) / (date_diff('day', min(date), max(date)) / 365.25)) - 1 AS cagr, min(down) AS max_dd, (avg(ret) - (pow(1.04, 1.0 / 252) - 1)) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(CASE WHEN exposed THEN 1.0 ELSE 0.0 END) AS time_in_market FROM m0 GROUP BY 1, 2, 3)
"""
R = lambda c: f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}"


def exposed(spark, d):
    return backtest.exposure(backtest.runs(flags(spark, d), HOLDS), RATE, max(HOLDS))


query("win08_trades", TRADE_SQL + f"SELECT signal, hold, trade, entry_date, exit_date, entry_price, exit_price, trade_return, {R('cash_return')} FROM tr")(lambda spark, d: backtest.trades(exposed(spark, d), RATE).select("signal", "hold", "trade", "entry_date", "exit_date", "entry_price", "exit_price", "trade_return", r6(F.col("cash_return")).alias("cash_return")))
query("win08_equity", TRADE_SQL + f"SELECT signal, hold, date, exposed, {R('log_equity')} FROM x")(lambda spark, d: exposed(spark, d).select("signal", "hold", "date", "exposed", r6(F.col("log_equity")).alias("log_equity")))
query("win09_time_in_market", TRADE_SQL + f"SELECT signal, hold, {R('time_in_market')} FROM m")(lambda spark, d: exposed(spark, d).groupBy("signal", "hold").agg(r6(F.avg(F.col("exposed").cast("double"))).alias("time_in_market")))
for key, name in (("agg09_cagr", "cagr"), ("agg10_sharpe", "sharpe"), ("agg11_max_drawdown", "max_dd")):
    scale = "1e3" if name == "cagr" else "1e6"
    query(key, TRADE_SQL + f"SELECT signal, hold, floor({name} * {scale} + 0.5) / {scale} AS {name} FROM m")(lambda spark, d, name=name, scale=float(scale): backtest.metrics(exposed(spark, d), RATE).select("signal", "hold", (F.floor(F.col(name) * scale + 0.5) / scale).alias(name)))
query("agg12_strategy", TRADE_SQL + "SELECT m.signal, m.hold, coalesce(count(trade), 0) AS n_trades, floor(coalesce(avg(CASE WHEN trade IS NULL THEN NULL WHEN trade_return > cash_return THEN 1.0 ELSE 0.0 END), 0) * 1e6 + 0.5) / 1e6 AS win_rate, floor(coalesce(avg(trade_return), 0) * 1e6 + 0.5) / 1e6 AS avg_return FROM m LEFT JOIN tr ON m.signal = tr.signal AND m.hold = tr.hold GROUP BY 1, 2")(lambda spark, d: backtest.sweep(flags(spark, d), HOLDS, RATE).select("signal", "hold", "n_trades", r6(F.col("win_rate")).alias("win_rate"), r6(F.col("avg_return")).alias("avg_return")))
PERIODS = {"full": (None, None), "before_1998": (None, "1997-12-31"), "from_1998": ("1998-01-01", None)}
SWEEP_HOLDS = [1, 2, 3, 5, 10, 20, 40, 60, 90]
BY = "PARTITION BY period, signal, hold"
SWEEP_SQL = f"""WITH {PANEL_SQL}, h(hold) AS (VALUES {", ".join(f"({n})" for n in SWEEP_HOLDS)}), sg(signal) AS (VALUES ('combined'), ('big_blue_day'), ('capitulation')),
pr(period, a, b) AS (VALUES {", ".join(f"('{k}', DATE '{a or '0001-01-01'}', DATE '{b or '9999-12-31'}')" for k, (a, b) in PERIODS.items())}),
gp AS (SELECT * FROM (SELECT period, date, eq_close, eq_ret, combined, big_blue_day, capitulation, row_number() OVER (PARTITION BY period ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY period) AS n FROM g JOIN pr ON date BETWEEN a AND b) WHERE n >= 100),
s AS (SELECT gp.*, signal, hold, CASE signal WHEN 'combined' THEN combined WHEN 'big_blue_day' THEN big_blue_day ELSE capitulation END AS fire FROM gp, h, sg),
k AS (SELECT *, lag(i) OVER ({BY} ORDER BY i) AS before FROM s WHERE fire),
t AS (SELECT *, sum(CASE WHEN before IS NULL OR i - before > hold THEN 1 ELSE 0 END) OVER ({BY} ORDER BY i ROWS UNBOUNDED PRECEDING) AS trade FROM k),
u AS (SELECT period, signal, hold, trade, min(i) AS entry_i, least(max(i) + hold, max(n) - 1) AS exit_i FROM t GROUP BY 1, 2, 3, 4),
tr AS (SELECT u.*, b.eq_close / a.eq_close - 1 AS trade_return, pow(pow(1.04, 1.0 / 252), exit_i - entry_i) - 1 AS cash_return FROM u JOIN gp a ON a.period = u.period AND a.i = entry_i JOIN gp b ON b.period = u.period AND b.i = exit_i),
ta AS (SELECT period, signal, hold, count(*) AS n_trades, avg(CASE WHEN trade_return > cash_return THEN 1.0 ELSE 0.0 END) AS win_rate, avg(trade_return) AS avg_return FROM tr GROUP BY 1, 2, 3),
x1 AS (SELECT *, coalesce(i - max(CASE WHEN fire THEN i END) OVER ({BY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= hold, false) AS exposed FROM s),
x AS (SELECT *, sum(CASE WHEN exposed THEN ln(1 + coalesce(eq_ret, 0)) ELSE ln(1.04) / 252 END) OVER ({BY} ORDER BY i ROWS UNBOUNDED PRECEDING) AS eq, sum(ln(1 + coalesce(eq_ret, 0))) OVER ({BY} ORDER BY i ROWS UNBOUNDED PRECEDING) AS held FROM x1),
m0 AS (SELECT *, exp(eq - lag(eq) OVER ({BY} ORDER BY i)) - 1 AS ret, exp(eq - max(eq) OVER ({BY} ORDER BY i ROWS UNBOUNDED PRECEDING)) - 1 AS down, exp(held - max(held) OVER ({BY} ORDER BY i ROWS UNBOUNDED PRECEDING)) - 1 AS held_down FROM x),
m AS (SELECT period, signal, hold, exp((arg_max(eq, i) - arg_min(eq, i)) / (date_diff('day', min(date), max(date)) / 365.25)) - 1 AS cagr, exp((arg_max(held, i) - arg_min(held, i)) / (date_diff('day', min(date), max(date)) / 365.25)) - 1 AS bh_cagr, min(down) AS max_dd, min(held_down) AS bh_dd, CASE WHEN stddev_samp(ret) > 1e-12 THEN (avg(ret) - (pow(1.04, 1.0 / 252) - 1)) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe, avg(CASE WHEN exposed THEN 1.0 ELSE 0.0 END) AS time_in_market FROM m0 GROUP BY 1, 2, 3)
SELECT m.period, m.signal, m.hold, floor(cagr * 1e3 + 0.5) / 1e3 AS cagr, {R("max_dd")}, {R("sharpe")}, coalesce(n_trades, 0) AS n_trades, floor(coalesce(win_rate, 0) * 1e6 + 0.5) / 1e6 AS win_rate, floor(coalesce(avg_return, 0) * 1e6 + 0.5) / 1e6 AS avg_return, {R("time_in_market")}, floor((max_dd - bh_dd) * 1e6 + 0.5) / 1e6 AS vs_hold_dd, cagr > bh_cagr AS beats_holding
FROM m LEFT JOIN ta ON ta.period = m.period AND ta.signal = m.signal AND ta.hold = m.hold"""


def swept(spark, d):
    s = backtest.sweep(flags(spark, d), SWEEP_HOLDS, RATE, PERIODS)
    six = ("max_dd", "sharpe", "win_rate", "avg_return", "time_in_market", "vs_hold_dd")
    return s.select("period", "signal", "hold", "n_trades", (F.floor(F.col("cagr") * 1e3 + 0.5) / 1e3).alias("cagr"), *(r6(F.col(c)).alias(c) for c in six), (F.col("vs_hold_cagr") > 0).alias("beats_holding"))


query("agg13_sweep", SWEEP_SQL)(swept)
query("src24_trades_csv", TRADE_SQL + "SELECT concat_ws(',', signal, CAST(hold AS VARCHAR), CAST(entry_date AS VARCHAR), CAST(exit_date AS VARCHAR)) AS line FROM tr")(lambda spark, d: tables.csv_lines(backtest.trades(exposed(spark, d), RATE), ["signal", "hold", "entry_date", "exit_date"]))

# --- screening
SCORES_SQL = """
s AS (SELECT *, CASE WHEN pe IS NOT NULL THEN greatest(0, least(100, (25 - pe) / 25 * 100)) END AS s_pe, CASE WHEN pfcf IS NOT NULL THEN greatest(0, least(100, (20 - pfcf) / 20 * 100)) END AS s_pfcf,
  CASE WHEN roe IS NOT NULL THEN greatest(0, least(100, roe / 0.40 * 100)) END AS s_roe, CASE WHEN roic IS NOT NULL THEN greatest(0, least(100, roic / 0.30 * 100)) END AS s_roic,
  CASE WHEN op_margin IS NOT NULL THEN greatest(0, least(100, op_margin / 0.40 * 100)) END AS s_op_margin, CASE WHEN de IS NOT NULL THEN greatest(0, least(100, (1 - de) * 100)) END AS s_de,
  CASE WHEN profit_margin IS NOT NULL THEN greatest(0, least(100, profit_margin / 0.30 * 100)) END AS s_profit_margin,
  CASE WHEN insider_pct IS NULL THEN NULL WHEN abs(insider_pct) <= 1 THEN 50.0 WHEN insider_pct >= 5 THEN 90.0 WHEN insider_pct > 0 THEN 75.0 WHEN insider_pct < -10 THEN 15.0 ELSE 30.0 END::DOUBLE AS s_insider,
  (pe IS NULL OR pe <= 20) AND (pfcf IS NULL OR pfcf <= 16) AND (de IS NULL OR de <= 0.8) AND (roe IS NULL OR roe * 100 >= 15) AND (op_margin IS NULL OR op_margin * 100 >= 12) AS passed FROM candidates),
c AS (SELECT *, coalesce((coalesce(s_pe * 15, 0) + coalesce(s_pfcf * 15, 0) + coalesce(s_roe * 15, 0) + coalesce(s_roic * 10, 0) + coalesce(s_op_margin * 10, 0) + coalesce(s_de * 15, 0) + coalesce(s_profit_margin * 10, 0) + coalesce(s_insider * 10, 0))
  / nullif(CASE WHEN s_pe IS NULL THEN 0 ELSE 15 END + CASE WHEN s_pfcf IS NULL THEN 0 ELSE 15 END + CASE WHEN s_roe IS NULL THEN 0 ELSE 15 END + CASE WHEN s_roic IS NULL THEN 0 ELSE 10 END + CASE WHEN s_op_margin IS NULL THEN 0 ELSE 10 END + CASE WHEN s_de IS NULL THEN 0 ELSE 15 END + CASE WHEN s_profit_margin IS NULL THEN 0 ELSE 10 END + CASE WHEN s_insider IS NULL THEN 0 ELSE 10 END, 0), 0) AS raw FROM s),
k AS (SELECT *, floor(raw * 10 + 0.5) / 10 AS composite FROM c),
rk AS (SELECT *, row_number() OVER (ORDER BY composite DESC, ticker) AS rank FROM k),
capped AS (SELECT *, CASE WHEN (SELECT count(DISTINCT sector) FROM rk WHERE passed AND rank <= 20) < 4 THEN 4 ELSE 3 END AS cap FROM rk),
q AS (SELECT *, CASE WHEN passed THEN row_number() OVER (PARTITION BY passed, sector ORDER BY rank) END AS of_sector FROM capped),
e AS (SELECT *, coalesce(passed AND of_sector <= cap, false) AS eligible FROM q),
pl AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY rank) END AS place FROM e)
"""


def candidates(spark, d):
    return view(spark, d, "candidates")


query("agg01_composite", f"WITH {SCORES_SQL} SELECT ticker, floor(raw * 1e6 + 0.5) / 1e6 AS composite FROM c")(lambda spark, d: screener.scored(candidates(spark, d), "orange").select("ticker", r6(F.col("composite")).alias("composite")))
query("agg02_factor_scores", f"WITH {SCORES_SQL} SELECT ticker, s_pe, s_pfcf, s_roe, s_roic, s_op_margin, s_de, s_profit_margin FROM s")(lambda spark, d: candidates(spark, d).select("ticker", *(c.alias(f"s_{n}") for n, c in screener.factor_scores().items() if n != "insider")))
query("agg03_insider", f"WITH {SCORES_SQL} SELECT ticker, s_insider FROM s")(lambda spark, d: candidates(spark, d).select("ticker", screener.insider_score(F.col("insider_pct")).alias("s_insider")))
query("flt06_thresholds", f"WITH {SCORES_SQL} SELECT ticker FROM s WHERE passed")(lambda spark, d: candidates(spark, d).where(screener.passes("orange")).select("ticker"))
query("win11_ranking", f"WITH {SCORES_SQL} SELECT ticker, composite, passed, rank FROM rk")(lambda spark, d: screener.ranked(candidates(spark, d), "orange").select("ticker", "composite", "passed", "rank"))
query("win12_sector_cap", f"WITH {SCORES_SQL} SELECT ticker, rank, CASE WHEN place <= 10 THEN 'picked' WHEN rank > coalesce((SELECT max(rank) FROM pl WHERE place = 10), 2147483647) THEN 'unreached' WHEN NOT passed THEN 'displaced: threshold' ELSE 'displaced: sector cap' END AS decision FROM pl")(lambda spark, d: screener.sector_cap(screener.ranked(candidates(spark, d), "orange")).select("ticker", "rank", "decision"))
query("agg24_sectors_near_top", f"WITH {SCORES_SQL} SELECT count(DISTINCT sector) AS sectors FROM rk WHERE passed AND rank <= 20")(lambda spark, d: screener.top_ranked(candidates(spark, d), "orange", 20).agg(F.count_distinct(F.when(F.col("passed"), F.col("sector"))).alias("sectors")))
query("win15_ranked_table", f"WITH {SCORES_SQL} SELECT row_number() OVER (ORDER BY rank) AS line, ticker, composite FROM rk WHERE passed AND rank <= 50")(lambda spark, d: screener.top_ranked(candidates(spark, d), "orange", 50).where("passed").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "composite"))).alias("rows")).select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).cast("bigint").alias("line"), "r.ticker", "r.composite"))
BANDS_SQL = "b(lo, hi, return_low, return_high, confidence) AS (VALUES (-1e300, 10.0, 12.0, 16.0, 'high'), (10.0, 15.0, 8.0, 12.0, 'high'), (15.0, 20.0, 5.0, 8.0, 'moderate'), (20.0, 25.0, 2.0, 5.0, 'moderate'), (25.0, 30.0, 0.0, 3.0, 'moderate'), (30.0, 1e300, -2.0, 0.0, 'low'))"
query("jn07_return_band", f"WITH {BANDS_SQL} SELECT ticker, coalesce(return_low, 0)::DOUBLE AS return_low, coalesce(return_high, 0)::DOUBLE AS return_high, (coalesce(return_low, 0)::DOUBLE + coalesce(return_high, 0)::DOUBLE) / 2 AS return_mid, coalesce(confidence, 'low') AS confidence FROM candidates LEFT JOIN b ON pe >= lo AND pe < hi")(lambda spark, d: screener.implied_returns(candidates(spark, d).select("ticker", "pe")).drop("pe"))


def priced(spark, d):
    return candidates(spark, d).where("pe IS NOT NULL AND pfcf IS NOT NULL").select("ticker", "pe", F.col("pfcf").alias("cape"), F.element_at(F.array(*map(F.lit, ("green", "orange", "red", "danger"))), F.col("ticker").cast("int") % 4 + 1).alias("color"))


PRICED_SQL = f"""{BANDS_SQL}, y AS (SELECT ticker, pe, pfcf AS cape, ['green', 'orange', 'red', 'danger'][CAST(ticker AS INT) % 4 + 1] AS color FROM candidates WHERE pe IS NOT NULL AND pfcf IS NOT NULL),
z AS (SELECT y.*, (coalesce(b.return_low, 0)::DOUBLE + coalesce(b.return_high, 0)::DOUBLE) / 2 AS return_mid, round(4.0 + CASE color WHEN 'green' THEN 4.0 WHEN 'orange' THEN 6.0 WHEN 'red' THEN 8.0 ELSE 10.0 END, 2)::DOUBLE AS hurdle_pct, (coalesce(c.return_low, 0)::DOUBLE + coalesce(c.return_high, 0)::DOUBLE) / 2 AS mid_after_fall
  FROM y LEFT JOIN b ON cape >= b.lo AND cape < b.hi LEFT JOIN b c ON cape * 0.85 >= c.lo AND cape * 0.85 < c.hi),
ver AS (SELECT *, CASE WHEN color = 'danger' OR return_mid < 4.0 THEN 'MAXIMUM T-BILLS' WHEN return_mid - hurdle_pct > 3 THEN 'STRONG EQUITY' WHEN abs(return_mid - hurdle_pct) <= 1 THEN 'NEUTRAL' WHEN return_mid > hurdle_pct THEN 'LEAN EQUITY' ELSE 'LEAN T-BILLS' END AS verdict FROM z)"""
query("mth03_verdict", f"WITH {PRICED_SQL} SELECT ticker, verdict, CASE verdict WHEN 'STRONG EQUITY' THEN 80 WHEN 'LEAN EQUITY' THEN 60 WHEN 'NEUTRAL' THEN 40 WHEN 'LEAN T-BILLS' THEN 20 ELSE 0 END AS equity_low, CASE verdict WHEN 'STRONG EQUITY' THEN 100 WHEN 'LEAN EQUITY' THEN 80 WHEN 'NEUTRAL' THEN 60 WHEN 'LEAN T-BILLS' THEN 40 ELSE 20 END AS equity_high FROM ver")(lambda spark, d: screener.expected_return(priced(spark, d), RATE).select("ticker", "verdict", screener.equity_range(F.col("verdict"))[0].alias("equity_low"), screener.equity_range(F.col("verdict"))[1].alias("equity_high")))
query("mth04_stance", "SELECT thesis, CASE WHEN color IN ('red', 'danger') OR number % 50 = 0 THEN 'Maximum Value Only' WHEN color = 'orange' THEN 'Tightened' ELSE 'Standard' END AS stance FROM theses")(lambda spark, d: view(spark, d, "theses").select("thesis", screener.stance(F.col("color"), F.col("number") % 50 == 0).alias("stance")))
query("mth05_expected_return", f"WITH {PRICED_SQL} SELECT ticker, pe, cape, color, return_mid, hurdle_pct, verdict, abs(pe - cape) > 5 AS diverges, mid_after_fall FROM ver")(lambda spark, d: screener.expected_return(priced(spark, d), RATE).select("ticker", "pe", "cape", "color", "return_mid", "hurdle_pct", "verdict", "diverges", "mid_after_fall"))
query("mth08_risk_free", "SELECT ticker, coalesce(pe, pfcf, roe) AS rate, CASE WHEN pe IS NOT NULL THEN 'argument' WHEN pfcf IS NOT NULL THEN 'treasury' WHEN roe IS NOT NULL THEN 'config' ELSE 'unresolved' END AS source FROM candidates")(lambda spark, d: candidates(spark, d).select("ticker", *(c.alias(n) for c, n in zip(screener.risk_free(F.col("pe"), F.col("pfcf"), F.col("roe")), ("rate", "source"), strict=True))))
query("src21_candidate_json", "SELECT ticker, sector, pe, roe FROM candidates")(lambda spark, d: tables.candidates_from_json(tables.json_lines(candidates(spark, d))).select("ticker", "sector", "pe", "roe"))
query("src22_from_fundamentals", "SELECT ticker, CASE WHEN pfcf <> 0 THEN pe / pfcf END AS pfcf, roe / 100 AS de FROM candidates")(lambda spark, d: screener.candidates_from_fundamentals(candidates(spark, d).select("ticker", F.col("pe").alias("market_cap"), F.col("pfcf").alias("free_cash_flow"), F.col("roe").alias("debt_to_equity"))).select("ticker", "pfcf", "de"))
query("src23_fallbacks", "SELECT ticker, coalesce(nullif(roe, 0), nullif(roic, 0), nullif(pe, 0)) AS value FROM candidates")(lambda spark, d: candidates(spark, d).select("ticker", screener.first_filled(F.col("roe"), F.col("roic"), F.col("pe")).alias("value")))
