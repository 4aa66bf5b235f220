"""Signal back-tests as windows within chunks of a series: trades are islands of fires, equity a running sum of logarithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import daily_rate
from .scan import CHUNK, chunked, in_chunk, running

SIGNALS = ("big_blue_day", "capitulation", "combined")
PERIOD = ["pair", "period"]
KEY = [*PERIOD, "signal", "hold"]


def periods_of(flags: DataFrame, periods: dict[str, tuple[str | None, str | None]] | None = None, least_rows: int = 100) -> DataFrame:
    """The panel once for each period: columns period, n (its dates); i counts from 0 in each. Periods of fewer than least_rows dates drop out. Returns stay those of the whole panel."""
    periods = periods or {"full": (None, None)}
    p = F.broadcast(flags.sparkSession.createDataFrame([(k, a or "0001-01-01", b or "9999-12-31") for k, (a, b) in periods.items()], "period string, first string, last string"))
    cut = flags.join(p, (F.col("date") >= F.to_date("first")) & (F.col("date") <= F.to_date("last"))).drop("first", "last")
    sizes = cut.groupBy(*PERIOD).agg(F.count("*").alias("n"), F.min("i").alias("_first")).where(F.col("n") >= least_rows)
    return cut.join(sizes, PERIOD).withColumn("i", F.col("i") - F.col("_first")).drop("_first")


def runs(flags: DataFrame, holds: list[int], periods: dict[str, tuple[str | None, str | None]] | None = None, signals: tuple[str, ...] = SIGNALS, least_rows: int = 100) -> DataFrame:
    """The panel once for each period, signal and hold: columns period, signal, hold, fire; i counts from 0 in each period."""
    each = periods_of(flags, periods, least_rows).withColumn("s", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("fire")) for s in signals))))
    return each.select("*", "s.signal", "s.fire", F.explode(F.array(*map(F.lit, holds))).alias("hold")).drop("s", *signals)


def exposure(r: DataFrame, rate_pct: float, longest: int, size: int = CHUNK) -> DataFrame:
    """Whether each date is in the market (a fire strictly before it within hold dates), what it multiplies equity by (factor, a logarithm), and log equity. longest: no hold is longer."""
    seen = chunked(r, longest, size)
    last = F.max(F.when(F.col("fire"), F.col("i"))).over(in_chunk(KEY).rowsBetween(-longest, -1))
    out = seen.withColumn("exposed", F.coalesce(F.col("i") - last <= F.col("hold"), F.lit(False))).where("inside").drop("inside")
    factor = F.when(F.col("exposed"), F.log1p(F.coalesce("eq_ret", F.lit(0.0)))).otherwise(F.log1p(daily_rate(F.lit(rate_pct))))
    return running(out.withColumn("factor", factor), KEY, {"log_equity": F.col("factor")})


def held(r: DataFrame, size: int = CHUNK) -> DataFrame:
    """Log equity of buying and holding, of each period."""
    factor = F.log1p(F.coalesce("eq_ret", F.lit(0.0)))
    return running(chunked(r, 0, size).withColumn("factor", factor), PERIOD, {"log_equity": F.col("factor")})


def trades(x: DataFrame, rate_pct: float) -> DataFrame:
    """One row per trade of exposed dates: entry and exit positions, dates and prices, returns of the trade and of cash meanwhile.

    A fire within hold dates of the one before extends its trade; the exit is clamped to the last date.
    """
    fires = running(x.where("fire"), KEY, {"trade": (~F.col("exposed")).cast("int")})  # a fire that no fire within hold dates precedes begins a trade
    spans = fires.groupBy(*KEY, "trade").agg(F.min("i").alias("entry_i"), F.least(F.max("i") + F.max("hold"), F.max("n") - 1).alias("exit_i"))
    price = x.select(*KEY, "i", "date", "eq_close")
    at = lambda side: price.select(*KEY, F.col("i").alias(f"{side}_i"), F.col("date").alias(f"{side}_date"), F.col("eq_close").alias(f"{side}_price"))
    out = spans.join(at("entry"), [*KEY, "entry_i"]).join(at("exit"), [*KEY, "exit_i"])
    return out.withColumn("trade_return", F.col("exit_price") / F.col("entry_price") - 1).withColumn("cash_return", F.pow(1 + daily_rate(F.lit(rate_pct)), F.col("exit_i") - F.col("entry_i")) - 1)


def metrics(equity: DataFrame, rate_pct: float, key: list[str] = KEY) -> DataFrame:
    """CAGR over 365.25-day years, largest drawdown and Sharpe of each curve (columns i, chunk, date, factor, log_equity), and the share of dates exposed where that is known.

    A standard deviation under 1e-12 counts as 0, and then so does Sharpe.
    """
    e = running(equity, key, maxima={"peak": F.col("log_equity")})
    e = e.withColumns({"ret": F.when(F.col("i") > 0, F.expm1("factor")), "down": F.expm1(F.col("log_equity") - F.col("peak"))})
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    growth = F.max_by("log_equity", "i") - F.min_by("log_equity", "i")
    rf = daily_rate(F.lit(rate_pct))
    spread = F.stddev_samp("ret")
    inside = [F.avg(F.col("exposed").cast("double")).alias("time_in_market")] if "exposed" in equity.columns else []
    return e.groupBy(*key).agg(
        F.when(years > 0, F.expm1(growth / years)).otherwise(0.0).alias("cagr"),
        F.min("down").alias("max_dd"),
        F.when((F.count("ret") >= 2) & (spread > 1e-12), (F.avg("ret") - rf) / spread * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        *inside,
    )


def sweep(flags: DataFrame, holds: list[int], rate_pct: float, periods: dict | None = None, size: int = CHUNK) -> DataFrame:
    """All metrics of each period, signal and hold, with differences to buy and hold."""
    x = exposure(runs(flags, holds, periods), rate_pct, max(holds), size)
    t = trades(x, rate_pct).groupBy(*KEY).agg(F.count("*").alias("n_trades"), F.avg((F.col("trade_return") > F.col("cash_return")).cast("double")).alias("win_rate"), F.avg("trade_return").alias("avg_return"))
    b = metrics(held(periods_of(flags, periods), size), rate_pct, PERIOD).select(*PERIOD, F.col("cagr").alias("bh_cagr"), F.col("max_dd").alias("bh_dd"))
    out = metrics(x, rate_pct).join(b, PERIOD).join(t, KEY, "left")
    zero = {"n_trades": 0, "win_rate": 0.0, "avg_return": 0.0}
    return out.na.fill(zero).select(*KEY, "cagr", "max_dd", "sharpe", "n_trades", "win_rate", "avg_return", "time_in_market", (F.col("cagr") - F.col("bh_cagr")).alias("vs_hold_cagr"), (F.col("max_dd") - F.col("bh_dd")).alias("vs_hold_dd"))
