"""Price series: returns, drawdown, volume, fire flags, regime and hurdle.

Windows are partitioned by ticker, so series run side by side, and those of a panel of two series by chunk besides (`scan`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import daily_rate, hurdle
from .scan import CHUNK, chunked, in_chunk, numbered


def by_date(partition: str = "ticker") -> Window:
    return Window.partitionBy(partition).orderBy("date")


def returns(bars: DataFrame, n: int, name: str = "ret") -> DataFrame:
    """n-bar simple return; NULL without n bars before."""
    return bars.withColumn(name, F.try_divide(F.col("close"), F.lag("close", n).over(by_date())) - 1)


def trailing_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume of the n bars before; NULL until there are n."""
    w = by_date().rowsBetween(-n, -1)
    return bars.withColumn("volume_avg", F.when(F.count("volume").over(w) == n, F.avg("volume").over(w)))


def drawdown(bars: DataFrame, n: int = 252) -> DataFrame:
    """Close against the highest close of the last n bars, this one included."""
    return bars.withColumn("drawdown", F.try_divide(F.col("close"), F.max("close").over(by_date().rowsBetween(1 - n, 0))) - 1)


def date_slice(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    for bound, test in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") <= d)):
        if bound is not None:
            bars = bars.where(test(F.to_date(F.lit(bound))))
    return bars


def log_equity(bars: DataFrame) -> DataFrame:
    """Logarithm of buy-and-hold equity; a missing return counts as 0."""
    r = returns(bars, 1)
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("log_equity", F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(w))


def cash_equity(bars: DataFrame, rate_pct: float) -> DataFrame:
    return bars.withColumn("equity", F.pow(1 + daily_rate(F.lit(rate_pct)), F.row_number().over(by_date())))


def panel(bars: DataFrame, equity: str = "EQ", bond: str = "BD", size: int = CHUNK) -> DataFrame:
    """One row per date both have: closes, returns, volume and its trailing mean, position i from 0."""
    a = bars.where(F.col("ticker") == equity).select("date", F.col("ticker").alias("of"), F.col("close").alias("eq_close"), F.col("volume").alias("eq_volume"))
    b = bars.where(F.col("ticker") == bond).select("date", F.col("ticker").alias("against"), F.col("close").alias("bd_close"))
    joined = a.join(b, "date").withColumn("pair", F.concat_ws("/", "of", "against"))
    rows = chunked(numbered(joined, ["pair"]), 20, size)
    w = in_chunk(["pair"])
    before = w.rowsBetween(-20, -1)
    return rows.select(
        "pair", "date", "eq_close", "bd_close", "eq_volume",
        (F.col("eq_close") / F.lag("eq_close").over(w) - 1).alias("eq_ret"),
        (F.col("bd_close") / F.lag("bd_close").over(w) - 1).alias("bd_ret"),
        F.when(F.count("eq_volume").over(before) == 20, F.avg("eq_volume").over(before)).alias("volume_avg"),
        "i", "inside",
    ).where("inside").drop("inside")


def fire_flags(p: DataFrame, move: float = 0.01, volume_times: float = 1.5) -> DataFrame:
    """Big blue day, capitulation, either; strict comparisons, NULL is false."""
    blue = (F.col("eq_ret") < -move) & (F.col("bd_ret") > move)
    cap = (F.col("eq_ret") < -move) & (F.col("bd_ret") < 0) & (F.col("eq_volume") > volume_times * F.col("volume_avg"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return p.withColumns({"big_blue_day": flag(blue), "capitulation": flag(cap), "combined": flag(blue) | flag(cap)})


def color(drawdown: Column, eq_ret: Column, bd_ret: Column, danger: float = -0.20) -> Column:
    """The first rule that holds: danger, red, green, blue, else orange."""
    return (
        F.when(drawdown <= danger, "danger")
        .when((eq_ret < -0.05) & (bd_ret < 0), "red")
        .when((eq_ret > 0) & (bd_ret > 0), "green")
        .when((eq_ret < 0) & (bd_ret > 0), "blue")
        .otherwise("orange")
    )


def regimes(bars: DataFrame, rate_pct: float | None = None, short: int = 20, long: int = 60, narrow: float = -0.05, tickers: tuple[str, str, str] = ("EQ", "BD", "EW")) -> DataFrame:
    """The regime of each date that all three series have, from the first with `long` bars before it."""
    eq, bd, ew = tickers
    r = returns(returns(returns(drawdown(bars), 1, "ret_1"), short, "ret_short"), long, "ret_long")
    r = trailing_volume(r)
    one = lambda t, *cols: r.where(F.col("ticker") == t).select("date", *(F.col(c).alias(f"{t.lower()}_{c}") for c in cols))
    e, b, w = eq.lower(), bd.lower(), ew.lower()
    j = one(eq, "ret_1", "ret_short", "ret_long", "drawdown", "volume", "volume_avg").join(one(bd, "ret_1", "ret_short", "ret_long"), "date").join(one(ew, "ret_long"), "date")
    j = j.where(F.col(f"{e}_ret_long").isNotNull() & F.col(f"{b}_ret_long").isNotNull() & F.col(f"{w}_ret_long").isNotNull())
    c = color(F.col(f"{e}_drawdown"), F.col(f"{e}_ret_short"), F.col(f"{b}_ret_short"))
    spread = F.col(f"{w}_ret_long") - F.col(f"{e}_ret_long")
    blue = (F.col(f"{e}_ret_1") < -0.01) & (F.col(f"{b}_ret_1") > 0.01)
    cap = (F.col(f"{e}_ret_1") < -0.01) & (F.col(f"{b}_ret_1") < 0) & F.coalesce(F.col(f"{e}_volume") > 1.5 * F.col(f"{e}_volume_avg"), F.lit(False))
    out = j.select("date", c.alias("color"), F.col(f"{e}_ret_short").alias("eq_ret_short"), F.col(f"{b}_ret_short").alias("bd_ret_short"), spread.alias("breadth_spread"), F.col(f"{e}_drawdown").alias("drawdown"), F.when(spread < narrow, "narrow").otherwise("broad").alias("breadth"), blue.alias("big_blue_day"), cap.alias("capitulation"))
    return out.withColumn("hurdle_pct", hurdle(F.lit(rate_pct).cast("double"), F.col("color")))
