"""Event-window market returns: as-of trading day, cumulative abnormal return, pre-event context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import expr as X


def _r(c, name):
    return F.round(c, 6).alias(name)


def returns(prices: DataFrame, market: DataFrame) -> DataFrame:
    """Stock and market simple returns on common days, with each ticker's day number; after a price of 0 infinite or NaN."""
    w = Window.partitionBy("ticker").orderBy("day")
    joined = prices.join(market.withColumnRenamed("price", "market_price"), "day")
    return joined.select("ticker", "day", "price", "market_price", F.row_number().over(w).alias("loc"), (X.ratio(F.col("price"), F.lag("price").over(w)) - 1).alias("ret"), (X.ratio(F.col("market_price"), F.lag("market_price").over(w)) - 1).alias("market_ret"))


def reaction_days(accepted: DataFrame, prices: DataFrame) -> DataFrame:
    """As-of join forward: the first trading day on or after the announcement, strictly after it when after the close."""
    a = accepted.select("ticker", "accepted_at", F.to_date("accepted_at").alias("d"), X.after_close(F.col("accepted_at")).alias("after_close"))
    on = (a.ticker == prices.ticker) & ((prices.day > a.d) | ((prices.day == a.d) & ~a.after_close))
    return a.join(prices, on, "left").groupBy(a.ticker, "accepted_at", "after_close").agg(F.min("day").alias("t0"))


def event_outcomes(accepted: DataFrame, prices: DataFrame, market: DataFrame, horizon: int = 5, history: int = 21) -> DataFrame:
    """Compounded returns before and the sum of abnormal returns after t0, with an error code where a window is short."""
    w = Window.partitionBy("ticker").orderBy("day")
    ahead = w.rowsBetween(1, horizon)
    since = lambda c, k: X.ratio(F.lag(c, 1).over(w), F.lag(c, k).over(w)) - 1
    r = returns(prices, market)
    r = r.select(
        "ticker", F.col("day").alias("t0"), "loc", F.count("*").over(Window.partitionBy("ticker")).alias("days"),
        F.sum(F.col("ret") - F.col("market_ret")).over(ahead).alias("car"),
        since("price", 6).alias("ret_5d"), since("price", 21).alias("ret_20d"), since("market_price", 21).alias("market_ret_20d"),
    )
    x = reaction_days(accepted, prices).join(r, ["ticker", "t0"], "left")
    error = F.when(F.col("t0").isNull(), "no_trading_day_on_or_after_event").when(F.col("loc") <= history, "not_enough_pre_event_history").when(F.col("loc") + horizon > F.col("days"), "not_enough_post_event_history")
    ok = error.isNull()
    val = lambda c: F.when(ok, X.rounded(F.col(c))).alias(c)
    return x.select("ticker", "t0", "after_close", error.alias("error"), val("ret_5d"), val("ret_20d"), val("market_ret_20d"), val("car"), F.when(ok, F.when(F.col("car") > 0.03, "positive").when(F.col("car") < -0.03, "negative").otherwise("mixed")).alias("valence"))


def abnormal_windows(prices: DataFrame, market: DataFrame, horizons=(5, 20)) -> DataFrame:
    """Sum of abnormal returns after every day, null where the window is cut off."""
    w = Window.partitionBy("ticker").orderBy("day")
    n = Window.partitionBy("ticker")
    r = returns(prices, market)
    cols = [F.when(F.col("loc") + h <= F.count("*").over(n), X.rounded(F.sum(F.col("ret") - F.col("market_ret")).over(w.rowsBetween(1, h)))).alias(f"car_{h}") for h in horizons]
    return r.select("ticker", "day", "loc", *cols)
