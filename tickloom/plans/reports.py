"""Reports over stored bars or features: each takes tables and returns one table.

Inputs are read several times, so pass stored or staged tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import features as ft
from tickloom.operators import ic, kyle, ledger, params, profile, quality, regime

IMBALANCE_SIGNALS = ("imbalance_last", "imbalance_ma_10s", "imbalance_ma_30s")


def volatility_report(feats: DataFrame, gamma: float = 0.01, kappa: float = 1.5) -> DataFrame:
    """Distribution of 60-row volatility, its tertiles and the spread each asks for."""
    t = profile.tertile_means(feats, "realized_vol_60s")
    return profile.distribution(feats, ["symbol"], "realized_vol_60s").join(profile.regime_spreads(t, gamma, kappa), "symbol")


def liquidity_report(feats: DataFrame, lot_size: float = 1.0) -> DataFrame:
    """Queue depth, tick size, busy and quiet runs, and the imbalance signal that calls direction best."""
    h = profile.imbalance_hits(feats, list(IMBALANCE_SIGNALS))
    best = h.groupBy("symbol").agg(
        F.max_by("signal", F.struct("hit_pct", "signal")).alias("best_signal"), F.max("hit_pct").alias("best_hit"))
    return (
        profile.queue_depth(feats, lot_size).join(profile.tick_size(feats), "symbol")
        .join(profile.run_lengths(feats), "symbol").join(best, "symbol", "left")
    )


def arrival_report(bars: DataFrame, max_gap: int = 60) -> DataFrame:
    """Gaps between bars, decay of arrivals with distance, and the spread distribution."""
    return (
        profile.interarrival(bars, max_gap).join(profile.arrival_decay(bars), "symbol", "left")
        .join(profile.spread_summary(bars), "symbol", "left")
    )


def regime_report(bars: DataFrame, labels: DataFrame, periods=(5, 10, 30, 60)) -> DataFrame:
    """Regime shares, variance ratios and Hurst exponent per symbol."""
    return (
        regime.regime_shares(labels, ["symbol"]).join(regime.variance_ratio(bars, periods).drop("character"), "symbol")
        .join(regime.hurst(bars), "symbol", "left")
    )


def kyle_report(bars: DataFrame, window: int = 30, min_bars: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per bar, per symbol and day)."""
    tox = kyle.toxicity(kyle.impact(bars, window, min_bars))
    return tox, kyle.daily_summary(tox)


def ic_report(pairs: DataFrame) -> DataFrame:
    """Half life of each signal's coefficient from the table of pairs."""
    return ic.ic_decay(ic.ic_table(pairs, ["symbol", "signal", "horizon"]))


def measured_signals(feats: DataFrame, horizons: list[int], cross_day: bool = True) -> DataFrame:
    """Imbalance measures with log returns ahead."""
    return ft.forward_returns(ft.imbalance_measures(feats, cross_day), horizons, "log", "mid", cross_day)


def coverage_report(bars: DataFrame, expected_symbols: int) -> tuple[DataFrame, DataFrame]:
    """(minute coverage per symbol and day, health per day)."""
    c = quality.minute_coverage(bars)
    return c, quality.health(c, expected_symbols)


def post_trade_report(fills: DataFrame, order: list[str]) -> DataFrame:
    """Session metrics with taxes and turnover."""
    f = ledger.with_costs(fills).groupBy("symbol", "date").agg(
        F.sum("stt").alias("stt"), F.sum("gst").alias("gst"),
        F.sum(F.col("price") * F.col("quantity") * F.col("lot_size")).alias("turnover"))
    return ledger.session_metrics(fills, order).join(f, ["symbol", "date"])


def best_of_grid(results: DataFrame, names: list[str], min_profit: float = 66.0) -> DataFrame:
    """Walk-forward winner of each symbol next to its steadiest combination."""
    win = params.best_params(params.walk_forward(results, names), names).select("symbol", *names, "rank_score", "fallback")
    steady = params.best_consistent(results, names, min_profit).select(
        "symbol", *[F.col(n).alias(f"steady_{n}") for n in names])
    return win.join(steady, "symbol")


def resolved_params(symbols: DataFrame, old: DataFrame, new: DataFrame, defaults: dict[str, float], alpha: float = 0.4) -> DataFrame:
    """Blended parameters looked up for every symbol, with the number of problems of the set used."""
    rows = params.blend(old, new, alpha)
    bad = params.health_issues(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_issues"))
    out = params.resolve(symbols, params.as_maps(rows), defaults).withColumn("_s", F.coalesce("base_symbol", "symbol"))
    return out.join(bad.withColumnRenamed("symbol", "_s"), "_s", "left").withColumn(
        "n_issues", F.coalesce("n_issues", F.lit(0))).drop("_s")
