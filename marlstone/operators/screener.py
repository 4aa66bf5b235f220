"""Multi-factor screening: thresholds, composite score, ranking, sector cap, valuation verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, hurdle, lookup
from .ordering import row_numbers

# Bounds by regime (largest P/E, P/FCF, D/E; least ROE and operating margin in per cent).
THRESHOLDS = {
    "green": (25.0, 20.0, 1.0, 12.0, 10.0),
    "blue": (25.0, 20.0, 1.0, 12.0, 10.0),
    "orange": (20.0, 16.0, 0.8, 15.0, 12.0),
    "red": (15.0, 12.0, 0.5, 18.0, 15.0),
    "danger": (15.0, 12.0, 0.5, 18.0, 15.0),
}
# Weights of the factors.
WEIGHTS = {"pe": 15.0, "pfcf": 15.0, "roe": 15.0, "roic": 10.0, "op_margin": 10.0, "de": 15.0, "profit_margin": 10.0, "insider": 10.0}
# P/E from, P/E below, ten-year return low and high in per cent, confidence.
RETURN_BANDS = [(None, 10.0, 12.0, 16.0, "high"), (10.0, 15.0, 8.0, 12.0, "high"), (15.0, 20.0, 5.0, 8.0, "moderate"), (20.0, 25.0, 2.0, 5.0, "moderate"), (25.0, 30.0, 0.0, 3.0, "moderate"), (30.0, None, -2.0, 0.0, "low")]


def passes(color: str) -> Column:
    """NULL metrics pass; bounds are inclusive."""
    pe, pfcf, de, roe, margin = THRESHOLDS.get(color.lower(), THRESHOLDS["orange"])
    ok = lambda test, c: F.col(c).isNull() | test
    return ok(F.col("pe") <= pe, "pe") & ok(F.col("pfcf") <= pfcf, "pfcf") & ok(F.col("de") <= de, "de") & ok(F.col("roe") * 100 >= roe, "roe") & ok(F.col("op_margin") * 100 >= margin, "op_margin")


def insider_score(x: Column) -> Column:
    return F.when(x.isNull(), None).when(F.abs(x) <= 1, 50.0).when(x >= 5, 90.0).when(x > 0, 75.0).when(x < -10, 15.0).otherwise(30.0)


def factor_scores(strict: bool = False) -> dict[str, Column]:
    """0 to 100 each, NULL for NULL. A negative ratio scores 100 as the cheapest; strict: 0."""
    cheap = lambda c, top: F.when(F.lit(strict) & (F.col(c) < 0), 0.0).otherwise(clamp((top - F.col(c)) / top * 100))
    share = lambda c, top: clamp(F.col(c) / top * 100)
    return {"pe": cheap("pe", 25), "pfcf": cheap("pfcf", 20), "roe": share("roe", 0.40), "roic": share("roic", 0.30), "op_margin": share("op_margin", 0.40), "de": clamp((1 - F.col("de")) * 100), "profit_margin": share("profit_margin", 0.30), "insider": insider_score(F.col("insider_pct"))}


def composite(scores: dict[str, Column]) -> Column:
    """Weighted mean over the factors there are; 0 without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, s in scores.items():
        total = total + F.coalesce(s * WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(s.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def scored(candidates: DataFrame, color: str, strict: bool = False) -> DataFrame:
    return candidates.withColumns({"composite": composite(factor_scores(strict)), "passed": passes(color)})


def rounded(candidates: DataFrame, color: str) -> DataFrame:
    """Scored, the composite rounded to one digit, as it is shown."""
    return scored(candidates, color).withColumn("composite", F.floor(F.col("composite") * 10 + 0.5) / 10)


def ranked(candidates: DataFrame, color: str, group: list[str] | None = None) -> DataFrame:
    """rank by composite, best first, then ticker; of each group if columns are given (one screen otherwise)."""
    s = rounded(candidates, color)
    if not group:
        return row_numbers(s, "rank", -F.col("composite"), [F.col("ticker")])
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("composite"), "ticker")))


def top_ranked(candidates: DataFrame, color: str, n: int) -> DataFrame:
    """The first n of the ranking, numbered; n is what a report shows."""
    first = rounded(candidates, color).orderBy(F.desc("composite"), "ticker").limit(n)
    return first.groupBy().agg(F.collect_list(F.struct(*first.columns)).alias("all")).select(F.posexplode(F.array_sort("all", lambda a, b: F.when(a["composite"] > b["composite"], -1).when(a["composite"] < b["composite"], 1).when(a["ticker"] < b["ticker"], -1).otherwise(1))).alias("rank", "r")).select("r.*", (F.col("rank") + 1).alias("rank"))


def sector_cap(ranks: DataFrame, size: int = 10, cap: int = 3, least_sectors: int = 4) -> DataFrame:
    """decision of each ranked row: picked, displaced: <why>, or unreached (below the last pick); place of those picked.

    The cap is one more where the passing rows of the first 2 * size ranks have fewer than least_sectors sectors. Of each sector only the rows that a cap can let through are sorted.
    """
    near = ranks.where(F.col("rank") <= 2 * size).agg(F.count_distinct(F.when(F.col("passed"), F.col("sector"))).alias("sectors"))
    best = ranks.where("passed").select("rank", "sector").withColumn("of_sector", F.row_number().over(Window.partitionBy("sector").orderBy("rank"))).where(F.col("of_sector") <= cap + 1)
    limit = F.when(F.col("sectors") < least_sectors, cap + 1).otherwise(cap)
    picks = best.crossJoin(F.broadcast(near)).where(F.col("of_sector") <= limit).orderBy("rank").limit(size)  # near: one row
    picks = picks.agg(F.array_sort(F.collect_list("rank")).alias("picks"))  # size numbers
    r = ranks.crossJoin(F.broadcast(picks))
    place = F.nullif(F.array_position("picks", F.col("rank")), F.lit(0))
    last = F.when(F.size("picks") == size, F.element_at("picks", -1)).otherwise(2**31 - 1)
    decision = F.when(place.isNotNull(), "picked").when(F.col("rank") > last, "unreached").when(~F.col("passed"), "displaced: threshold").otherwise("displaced: sector cap")
    return r.withColumns({"place": place.cast("int"), "decision": decision}).drop("picks")


def return_bands(spark: SparkSession) -> DataFrame:
    rows = [(float("-inf") if a is None else a, float("inf") if b is None else b, lo, hi, c) for a, b, lo, hi, c in RETURN_BANDS]
    return F.broadcast(spark.createDataFrame(rows, "pe_from double, pe_to double, return_low double, return_high double, confidence string"))  # six rows


def implied_returns(rows: DataFrame, pe: str = "pe") -> DataFrame:
    """return_low, return_high, return_mid, confidence by half-open P/E bands; NaN gives 0, 0, low."""
    x = F.when(~F.isnan(pe), F.col(pe))
    out = rows.join(return_bands(rows.sparkSession), (x >= F.col("pe_from")) & (x < F.col("pe_to")), "left").drop("pe_from", "pe_to")
    out = out.withColumns({"return_low": F.coalesce("return_low", F.lit(0.0)), "return_high": F.coalesce("return_high", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit("low"))})
    return out.withColumn("return_mid", (F.col("return_low") + F.col("return_high")) / 2)


def verdict(mid: Column, rate: Column, hurdle_pct: Column, danger: Column) -> Column:
    spread = mid - hurdle_pct
    return F.when(danger | (mid < rate), "MAXIMUM T-BILLS").when(spread > 3, "STRONG EQUITY").when(F.abs(spread) <= 1, "NEUTRAL").when(spread > 0, "LEAN EQUITY").otherwise("LEAN T-BILLS")


def equity_range(v: Column) -> tuple[Column, Column]:
    low = lookup(v, {"STRONG EQUITY": 80, "LEAN EQUITY": 60, "NEUTRAL": 40, "LEAN T-BILLS": 20, "MAXIMUM T-BILLS": 0})
    return low, low + 20


def stance(color: Column, danger: Column) -> Column:
    return F.when(danger | color.isin("red", "danger"), "Maximum Value Only").when(color == "orange", "Tightened").otherwise("Standard")


def expected_return(rows: DataFrame, rate_pct: float) -> DataFrame:
    """Per row (pe, cape, color): band of the cyclical P/E, its midpoint against the hurdle, verdict, divergence of the two P/Es by over 5, and the midpoint after a 15 % fall."""
    r = implied_returns(rows, "cape").withColumn("hurdle_pct", hurdle(F.lit(rate_pct), F.col("color")))
    after = implied_returns(r.select("ticker", (F.col("cape") * 0.85).alias("after")), "after").select("ticker", F.col("return_mid").alias("mid_after_fall"))
    r = r.withColumn("verdict", verdict(F.col("return_mid"), F.lit(rate_pct), F.col("hurdle_pct"), F.col("color") == "danger"))
    return r.withColumn("diverges", F.abs(F.col("pe") - F.col("cape")) > 5).join(after, "ticker")


def risk_free(argument: Column, live: Column, config: Column) -> tuple[Column, Column]:
    """The first rate there is, and where it is from."""
    return F.coalesce(argument, live, config), F.when(argument.isNotNull(), "argument").when(live.isNotNull(), "treasury").when(config.isNotNull(), "config").otherwise("unresolved")


def candidates_from_fundamentals(f: DataFrame) -> DataFrame:
    """P/FCF = market cap / free cash flow unless that is NULL or 0; D/E comes in per cent."""
    return f.withColumns({"pfcf": F.try_divide(F.col("market_cap"), F.nullif(F.col("free_cash_flow"), F.lit(0.0))), "de": F.col("debt_to_equity") / 100})


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor 0: the fallback rule of loose mappings."""
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in cols))


def contexts(rows: DataFrame) -> DataFrame:
    """Screen contexts (color, rate_pct, ...) with their hurdle and stance; no rate, no hurdle."""
    return rows.withColumn("hurdle_pct", hurdle(F.col("rate_pct"), F.col("color"))).withColumn("stance", stance(F.col("color"), F.col("color") == "danger"))
