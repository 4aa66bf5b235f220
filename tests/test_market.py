"""Series, regimes, back-tests and screening against hand-computed values."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.operators import backtest, scan, screener, series

START = dt.date(2024, 1, 1)
BARS = "ticker string, date date, close double, volume bigint"


def ramp(ticker, closes, volumes=None):
    return [(ticker, START + dt.timedelta(days=i), float(c), int(volumes[i]) if volumes else 100) for i, c in enumerate(closes)]


def line(a, b, n=70):
    return [a + (b - a) * i / (n - 1) for i in range(n)]


@pytest.mark.parametrize(
    ("eq", "bd", "color"),
    [
        (line(100, 108), line(100, 104), "green"),
        (line(110, 104), line(100, 104), "blue"),
        (line(100, 110), line(100, 95), "orange"),
        (line(120, 99), line(100, 92), "red"),
        (line(150, 200, 100) + line(200, 150, 160), line(100, 104, 260), "danger"),
    ],
)
def test_regime_colors(spark, eq, bd, color):
    n = len(eq)
    bars = spark.createDataFrame(ramp("EQ", eq) + ramp("BD", bd) + ramp("EW", line(100, 108, n)), BARS)
    last = series.regimes(bars, 4.5).orderBy(F.desc("date")).first()
    assert last["color"] == color
    assert last["hurdle_pct"] == {"green": 8.5, "blue": 8.5, "orange": 10.5, "red": 12.5, "danger": 14.5}[color]


def test_short_series_have_no_regime(spark):
    bars = spark.createDataFrame(ramp("EQ", line(1, 2, 60)) + ramp("BD", line(1, 2, 60)) + ramp("EW", line(1, 2, 60)), BARS)
    assert series.regimes(bars).count() == 0


@pytest.mark.parametrize(("eq", "bd", "volume", "want"), [(-0.02, 0.02, 100, (True, False)), (-0.02, -0.01, 200, (False, True)), (-0.0099, 0.02, 200, (False, False)), (-0.02, -0.01, 150, (False, False))])
def test_fire_flags(spark, eq, bd, volume, want):
    bars = spark.createDataFrame(ramp("EQ", [100] * 69 + [100 * (1 + eq)], [100] * 69 + [volume]) + ramp("BD", [100] * 69 + [100 * (1 + bd)]), BARS)
    r = series.fire_flags(series.panel(bars), 0.01).orderBy(F.desc("date")).first()
    assert (r["big_blue_day"], r["capitulation"]) == want


def sequential(fires, closes, hold, rf):
    """Trades and the dates in the market, one date after another."""
    trades, inside, end = [], [], None
    for i, fire in enumerate(fires):
        inside.append(end is not None and i <= end)
        if end is not None and i > end:
            end = None
        if fire:
            stop = min(i + hold, len(fires) - 1)
            if end is None:
                trades.append([i, stop])
            else:
                trades[-1][1] = stop
            end = stop
    return [(a, b, closes[b] / closes[a] - 1) for a, b in trades], inside


def test_trades_equal_a_sequential_run(spark):
    rng = random.Random(3)
    closes = [100.0]
    for _ in range(149):
        closes.append(closes[-1] * (1 + rng.uniform(-0.05, 0.05)))
    fires = [rng.random() < 0.08 for _ in closes]
    fires[-1] = True
    rows = [("p", i, START + dt.timedelta(days=i), c, (c / closes[i - 1] - 1 if i else None), f, False, f) for i, (c, f) in enumerate(zip(closes, fires, strict=True))]
    flags = spark.createDataFrame(rows, "pair string, i long, date date, eq_close double, eq_ret double, big_blue_day boolean, capitulation boolean, combined boolean")
    r = backtest.runs(flags, [1, 5, 20], signals=("combined",))
    for size in (150, 75, 22):  # 1, 2 and 7 chunks
        x = backtest.exposure(r, 4.0, 20, size).cache()
        assert x.select("chunk").distinct().count() == -(-150 // size)
        dates, found = x.orderBy("i").collect(), backtest.trades(x, 4.0).orderBy("entry_i").collect()
        figures = {m["hold"]: m for m in backtest.metrics(x, 4.0).collect()}
        for hold in (1, 5, 20):
            trades, inside = sequential(fires, closes, hold, 4)
            got = [t for t in found if t["hold"] == hold]
            assert [(t["entry_i"], t["exit_i"]) for t in got] == [t[:2] for t in trades] and [t["trade"] for t in got] == list(range(1, len(got) + 1))
            assert [t["trade_return"] for t in got] == pytest.approx([t[2] for t in trades])
            assert [d["exposed"] for d in dates if d["hold"] == hold] == inside
            equity, peak, down = 1.0, 0.0, 0.0
            for i, d in enumerate(d for d in dates if d["hold"] == hold):
                equity *= closes[i] / closes[i - 1] if inside[i] else 1.04 ** (1 / 252)
                assert d["log_equity"] == pytest.approx(math.log(equity))
                peak = max(peak, equity)
                down = min(down, equity / peak - 1)
            assert figures[hold]["max_dd"] == pytest.approx(down) and figures[hold]["time_in_market"] == pytest.approx(sum(inside) / 150)


def test_panel_is_the_same_in_any_chunks(spark):
    rng = random.Random(8)
    bars = spark.createDataFrame(ramp("EQ", [100 + rng.random() for _ in range(150)], [100 + rng.randrange(90) for _ in range(150)]) + ramp("BD", [100 + rng.random() for _ in range(150)]), BARS)
    one, two, seven = (series.panel(bars, size=n).orderBy("date").collect() for n in (150, 75, 22))
    assert one == two == seven
    assert [r["i"] for r in one] == list(range(150)) and one[0]["eq_ret"] is None and one[19]["volume_avg"] is None and one[20]["volume_avg"] == pytest.approx(sum(r["eq_volume"] for r in one[:20]) / 20)


def test_gaps_between_chunks_and_short_series(spark):
    days = [0, 1, 400, 401, 2000, 2001, 2002]
    rows = [(k, START + dt.timedelta(days=d), float(n)) for k, ds in (("a", days), ("b", days[:1])) for n, d in enumerate(ds)]
    x = scan.chunked(scan.numbered(spark.createDataFrame(rows, "k string, date date, v double").repartition(3), ["k"]), 0, 2)
    got = scan.running(x, ["k"], {"total": F.col("v")}, {"most": -F.col("v")}).orderBy("k", "i").collect()
    assert [(r["k"], r["i"], r["total"], r["most"]) for r in got] == [("a", n, n * (n + 1) / 2, 0.0) for n in range(7)] + [("b", 0, 0.0, 0.0)]


def test_constant_returns_have_no_sharpe(spark):
    rows = [("p", "full", "cash", 1, i, i // 100, START + dt.timedelta(days=i), 0.0001, i * 0.0001) for i in range(300)]
    m = backtest.metrics(spark.createDataFrame(rows, "pair string, period string, signal string, hold int, i long, chunk long, date date, factor double, log_equity double"), 4.0).first()
    assert m["sharpe"] == 0 and m["max_dd"] == 0


CANDIDATE = "ticker string, sector string, pe double, pfcf double, roe double, roic double, op_margin double, profit_margin double, de double, insider_pct double"


def candidate(ticker, sector="TEC", **changes):
    base = {"pe": 12.0, "pfcf": 10.0, "roe": 0.20, "roic": 0.18, "op_margin": 0.30, "profit_margin": 0.20, "de": 0.30, "insider_pct": 0.0} | changes
    return (ticker, sector, *base.values())


def test_scores(spark):
    none = dict.fromkeys(("pe", "pfcf", "roe", "roic", "op_margin", "profit_margin", "de", "insider_pct"))
    df = spark.createDataFrame([candidate("A"), candidate("B", pe=-5.0), candidate("C", **none), candidate("D", **(none | {"pe": 30.0}))], CANDIDATE)
    r = {x["ticker"]: x for x in screener.scored(df, "green").collect()}
    assert r["B"]["composite"] > r["A"]["composite"]  # a negative ratio is the cheapest
    assert r["C"]["composite"] == 0 and r["C"]["passed"]
    assert r["D"]["composite"] == 0 and not r["D"]["passed"]
    strict = {x["ticker"]: x["composite"] for x in screener.scored(df, "green", strict=True).collect()}
    assert strict["B"] < r["A"]["composite"]


@pytest.mark.parametrize(("x", "want"), [(None, None), (1.0, 50.0), (-1.0, 50.0), (1.5, 75.0), (5.0, 90.0), (-10.0, 30.0), (-10.5, 15.0)])
def test_insider_bands(spark, x, want):
    assert spark.range(1).select(screener.insider_score(F.lit(x).cast("double")).alias("s")).first()["s"] == want


def test_sector_cap(spark):
    rows = [(f"FIN{i}", "FIN", True, i) for i in range(1, 5)] + [("TEC1", "TEC", True, 5), ("HC1", "HC", True, 6), ("IND1", "IND", False, 7)]
    ranks = spark.createDataFrame(rows, "ticker string, sector string, passed boolean, rank int")
    got = {x["ticker"]: x["decision"] for x in screener.sector_cap(ranks, least_sectors=3).collect()}
    assert got["FIN4"] == "displaced: sector cap" and got["IND1"] == "displaced: threshold" and got["HC1"] == "picked"
    relaxed = {x["ticker"]: x["decision"] for x in screener.sector_cap(ranks).collect()}
    assert relaxed["FIN4"] == "picked"


@pytest.mark.parametrize(("pe", "low", "high", "conf"), [(8, 12, 16, "high"), (10, 8, 12, "high"), (17, 5, 8, "moderate"), (22, 2, 5, "moderate"), (27, 0, 3, "moderate"), (30, -2, 0, "low"), (float("nan"), 0, 0, "low")])
def test_return_bands(spark, pe, low, high, conf):
    r = screener.implied_returns(spark.createDataFrame([(float(pe),)], "pe double")).first()
    assert (r["return_low"], r["return_high"], r["confidence"]) == (low, high, conf)


@pytest.mark.parametrize(("mid", "danger", "want"), [(20.0, True, "MAXIMUM T-BILLS"), (3.0, False, "MAXIMUM T-BILLS"), (12.0, False, "STRONG EQUITY"), (9.0, False, "NEUTRAL"), (10.0, False, "LEAN EQUITY"), (5.0, False, "LEAN T-BILLS")])
def test_verdicts(spark, mid, danger, want):
    v = screener.verdict(F.lit(mid), F.lit(4.0), F.lit(8.5), F.lit(danger))
    assert spark.range(1).select(v.alias("v")).first()["v"] == want


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(scalar.us_or_iso_date(F.lit("05/06/2026"))) == dt.date(2026, 5, 6)
    assert get(scalar.us_or_iso_date(F.lit("2026-05-06"))) == dt.date(2026, 5, 6)
    assert get(scalar.us_or_iso_date(F.lit("soon"))) is None
    assert get(scalar.money(F.lit("$1.5B"))) == 1.5e9 and get(scalar.money(F.lit("12,000"))) == 12000.0 and get(scalar.money(F.lit("n/a"))) is None
    assert get(scalar.slug(F.lit("  Risk Factors! "))) == "risk-factors"
    assert get(scalar.clamp(F.lit(None).cast("double"))) is None
    assert get(scalar.without_style_prefix(F.lit("xslF345X06/doc.xml"))) == "doc.xml"
