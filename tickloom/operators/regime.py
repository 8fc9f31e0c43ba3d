"""Persistence and regime statistics of a price series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import finite, pearson, ratio
from tickloom.operators.frames import BLOCK_ROWS, span, with_position
from tickloom.operators.profile import unpivot
from tickloom.operators.ranks import quantiles, trim
from tickloom.operators.rolling import Frame, rolling

LABELS = ("MEAN_REVERTING", "CHOPPY", "TRENDING", "VOLATILE")


def _returns(bars: DataFrame, q: int, name: str, block_rows: int) -> DataFrame:
    s = span(bars.select("symbol", "date", "ts_sec", "close"), True, back=q, block_rows=block_rows)
    d = s.df.withColumn(name, F.col("close") / s.lag("close", q) - 1)
    return s.close(d).where(F.col(name).isNotNull())


def _character(x, low, high):
    return F.when(x < low, "MEAN_REVERTING").when(x > high, "TRENDING").otherwise("CHOPPY")


def return_autocorr(bars: DataFrame, lags=(1, 5, 10, 30, 60), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Autocorrelation of trimmed returns, one column per lag."""
    r = trim(_returns(bars, 1, "ret", block_rows), ["symbol"], "ret")
    s = span(r, True, back=max(lags), block_rows=block_rows)
    d = s.close(s.df.withColumns({f"_l{k}": s.lag("ret", k) for k in lags}))
    g = d.groupBy("symbol").agg(*[pearson("ret", f"_l{k}").alias(f"acf_{k}") for k in lags])
    return g.withColumn("character", _character(F.col(f"acf_{lags[0]}"), -0.05, 0.05))


def daily_autocorr(bars: DataFrame, min_rows: int = 100) -> DataFrame:
    s = span(bars)
    d = s.df.withColumn("ret", F.col("close") / s.lag("close") - 1)
    d = d.withColumn("_l1", s.lag("ret"))
    return d.groupBy("symbol", "date").agg(
        pearson("ret", "_l1").alias("acf_1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)


def vol_autocorr(feats: DataFrame, vol: str = "realized_vol_60s", max_lag: int = 120,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Autocorrelation by lag in one pass: all lags are columns of the same sorted rows."""
    d = feats.where(finite(vol) & (F.col(vol) > 0)).select("symbol", "date", "ts_sec", F.col(vol).alias("v"))
    s = span(d, True, back=max_lag, block_rows=block_rows)
    d = s.close(s.df.withColumns({f"_l{k}": s.lag("v", k) for k in range(1, max_lag + 1)}))
    g = d.groupBy("symbol").agg(*[pearson("v", f"_l{k}").alias(f"_c{k}") for k in range(1, max_lag + 1)])
    stack = ", ".join(f"{k}, _c{k}" for k in range(1, max_lag + 1))
    return g.selectExpr("symbol", f"stack({max_lag}, {stack}) AS (lag, acf)").where("acf IS NOT NULL")


def vol_half_life(acf: DataFrame, max_lag: int = 120) -> DataFrame:
    return acf.groupBy("symbol").agg(
        F.coalesce(F.min(F.when(F.col("acf") < 0.5, F.col("lag"))), F.lit(max_lag)).alias("half_life"),
        F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("acf_lag1"))


def variance_ratio(bars: DataFrame, periods=(5, 10, 30, 60), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Variance of q-row returns over q times that of one-row returns, both trimmed."""
    s = span(bars.select("symbol", "date", "ts_sec", "close"), True, back=max(periods), block_rows=block_rows)
    qs = (1, *periods)
    d = s.close(s.df.withColumns({f"r{q}": F.col("close") / s.lag("close", q) - 1 for q in qs}))
    long = unpivot(d, ["symbol"], [f"r{q}" for q in qs], "q", "r").where(F.col("r").isNotNull())
    v = trim(long, ["symbol", "q"], "r").groupBy("symbol").agg(
        *[F.var_samp(F.when(F.col("q") == f"r{q}", F.col("r"))).alias(f"_v{q}") for q in qs])
    out = v.select("symbol", *[ratio(f"_v{q}", F.col("_v1") * q).alias(f"vr_{q}") for q in periods])
    return out.withColumn("character", _character(F.col("vr_10"), 0.95, 1.05)) if 10 in periods else out


def hurst(bars: DataFrame, by_day: bool = False, min_lag: int = 2, max_lag: int = 100,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Slope of log rescaled range on log window length.

    Windows of every length are summed where their rows already lie: a task holds
    one block with the ``max_lag`` rows after it and returns one line per length.
    """
    keys = ["symbol", "date"] if by_day else ["symbol"]
    if by_day:
        s = span(bars.select("symbol", "date", "ts_sec", "close"))
        r = s.df.withColumn("ret", F.col("close") / s.lag("close") - 1).where("ret IS NOT NULL")
        w = Window.partitionBy(*keys).orderBy("ts_sec")
        r = r.withColumns({"_pos": F.row_number().over(w) - 1, "_blk": F.lit(0)})
    else:
        r = span(_returns(bars, 1, "ret", block_rows), True, back=0, ahead=max_lag, block_rows=block_rows).df
    total = r.groupBy(*keys).agg((F.max("_pos") + 1).alias("_n")).where(f"_n >= {2 * max_lag}")
    step = block_rows if not by_day else 1 << 40
    r = r.join(total, keys).select(*keys, "_blk", "_pos", "_n", "ret")
    out = ", ".join(["symbol string"] + (["date date"] if by_day else []) + ["lag int", "s double", "c long"])

    def sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        x, first, n = pdf["ret"].to_numpy(), int(pdf["_pos"].iloc[0]), int(pdf["_n"].iloc[0])
        own_from, own_to = int(key[-1]) * step, (int(key[-1]) + 1) * step
        lines = []
        for lag in range(min_lag, max_lag):
            if n // lag < 2:
                continue
            a = -(-max(own_from, first) // lag) * lag
            b = min(own_to, n - lag + 1)
            k = max(0, -(-(b - a) // lag))
            if k == 0:
                continue
            win = x[a - first:a - first + k * lag].reshape(k, lag)
            dev = np.cumsum(win - win.mean(axis=1, keepdims=True), axis=1)
            sd = win.std(axis=1)
            ok = sd > 0
            lines.append((*key[:-1], lag, float(((dev.max(axis=1) - dev.min(axis=1))[ok] / sd[ok]).sum()), int(ok.sum())))
        return pd.DataFrame(lines, columns=[*keys, "lag", "s", "c"])

    rs = r.groupBy(*keys, "_blk").applyInPandas(sums, out).groupBy(*keys, "lag").agg(
        (F.sum("s") / F.sum("c")).alias("rs")).where("rs > 0")
    fit = rs.groupBy(*keys).agg(
        F.regr_slope(F.log("rs"), F.log("lag")).alias("hurst"), F.count(F.lit(1)).alias("n_lags"))
    return fit.where("n_lags >= 5").withColumn("character", _character(F.col("hurst"), 0.45, 0.55))


def regime_labels(feats: DataFrame, window: int = 300, q: int = 10, cross_day: bool = True,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label of each bar from the ``window`` rows before it: volatility gate, then variance ratio."""
    p75 = quantiles(feats, ["symbol"], "realized_vol_60s", {"_p75": 0.75})
    s = span(feats, cross_day, back=window + q + 1, block_rows=block_rows, blocks=True)
    d = s.df.withColumns({
        "_r1": F.col("close") / s.lag("close") - 1, "_rq": F.col("close") / s.lag("close", q) - 1, "_i": s.pos})
    d = rolling(s, d, {
        "_s1": Frame("std", "_r1", window - 1, 1), "_sq": Frame("std", "_rq", window - q, 1),
        "vol_before": Frame("mean", "realized_vol_60s", window, 1)})
    d = s.close(d.withColumn("vr", ratio(F.col("_sq") * F.col("_sq"), F.col("_s1") * F.col("_s1") * q)))
    d = d.drop("_s1", "_sq")
    return d.join(p75, "symbol").withColumn(
        "regime",
        F.when(F.col("_i") < window, "CHOPPY")
        .when(F.col("vol_before") > F.col("_p75") * 1.5, "VOLATILE")
        .when(F.col("vr") < 0.85, "MEAN_REVERTING").when(F.col("vr") > 1.15, "TRENDING").otherwise("CHOPPY"),
    ).drop("_r1", "_rq", "_i", "_p75")


def regime_shares(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(*[
        (F.avg((F.col("regime") == r).cast("int")) * 100).alias(f"pct_{r.lower()}") for r in LABELS])


def regime_outcome(shares: DataFrame, results: DataFrame) -> DataFrame:
    """Regime shares of days against their result: correlation, and means of good and bad days."""
    d = shares.join(results, ["symbol", "date"]).withColumn("profitable", F.col("pnl") > 0)
    cols = [f"pct_{r.lower()}" for r in LABELS]
    long = unpivot(d, ["pnl", "profitable"], cols, "regime", "pct")
    return long.groupBy("regime").agg(
        pearson("pct", "pnl").alias("corr"), F.avg(F.when(F.col("profitable"), F.col("pct"))).alias("mean_profitable"),
        F.avg(F.when(~F.col("profitable"), F.col("pct"))).alias("mean_losing"), F.count(F.lit(1)).alias("n"))


def momentum_threshold(labels: DataFrame, mom: str = "price_mom_60s", ahead: int = 60,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """p75 of trimmed momentum, how often strong momentum is trending, and its forward correlation."""
    t = trim(labels.where(F.col(mom).isNotNull()), ["symbol"], mom).withColumn("_a", F.abs(mom))
    thr = quantiles(t, ["symbol"], "_a", {"threshold": 0.75})
    s = span(labels.select("symbol", "date", "ts_sec", "close", "regime", mom), True, ahead=ahead, block_rows=block_rows)
    d = s.close(s.df.withColumn("fwd", s.lead("close", ahead) / F.col("close") - 1)).join(thr, "symbol")
    strong = F.abs(mom) > F.col("threshold")
    g = d.groupBy("symbol", "threshold").agg(
        (F.avg(F.when(strong, (F.col("regime") == "TRENDING").cast("int"))) * 100).alias("pct_trending"),
        pearson(mom, "fwd").alias("fwd_corr"))
    return g.withColumn("pause_signal", (F.col("pct_trending") > 30) | (F.abs("fwd_corr") > 0.05))


def ewm_std(df: DataFrame, value: str, name: str, weight: float = 60) -> DataFrame:
    """Exponentially weighted deviation (bias-corrected) over the last rows; ``weight``: the span, above 1.

    A block holds as many rows before its own as it takes for weights to fall
    below the precision of a double, about 18.5 times ``weight``; within a block
    running sums of rescaled values give every row in constant time. Three such
    stretches scale by e^111 at most, so nothing overflows.
    """
    if weight <= 1:
        raise ValueError("weight must be above 1")
    decay = 1 - 2 / (weight + 1)
    kernel_rows = math.ceil(-37 / math.log(decay))
    s = span(df, True, back=kernel_rows, block_rows=2 * kernel_rows)
    run = s.line.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    seen = F.count(v).over(run)
    d = s.df.withColumn("_t", (F.col("_pos") - F.col("_blk") * (2 * kernel_rows)).cast("double"))
    g = F.pow(F.lit(1 / decay), F.col("_t"))
    d = d.withColumns({
        "_w": F.sum(F.when(v.isNotNull(), g)).over(run), "_w2": F.sum(F.when(v.isNotNull(), g * g)).over(run),
        "_m": F.sum(g * v).over(run), "_n": seen})
    mean = F.col("_m") / F.col("_w")
    d = d.withColumn("_mean", mean)
    # second moment about the running mean of the block keeps the subtraction small
    d = d.withColumn("_c", F.avg(v).over(Window.partitionBy(*s.part)))
    d = d.withColumns({
        "_q1": F.sum(g * (v - F.col("_c"))).over(run) / F.col("_w"),
        "_q2": F.sum(g * (v - F.col("_c")) * (v - F.col("_c"))).over(run) / F.col("_w")})
    bias = F.col("_w") * F.col("_w") / F.when(F.col("_n") > 1, F.col("_w") * F.col("_w") - F.col("_w2"))
    var = F.greatest(F.col("_q2") - F.col("_q1") * F.col("_q1"), F.lit(0.0)) * bias
    d = d.withColumn(name, F.sqrt(var))
    return s.close(d.drop("_t", "_w", "_w2", "_m", "_n", "_mean", "_c", "_q1", "_q2"))


def sigma_estimators(feats: DataFrame, horizon: int = 60, min_rows: int = 50, roll: int = 300,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Four volatility estimators against the volatility ``horizon`` rows later."""
    s = span(feats.select("symbol", "date", "ts_sec", "close", "realized_vol_60s", "realized_vol_300s"),
             True, back=roll + 1, ahead=horizon, block_rows=block_rows)
    vol = F.col("realized_vol_60s")
    d = s.df.withColumns({
        "target": s.lead("realized_vol_60s", horizon), "est_60s": vol, "est_300s": F.col("realized_vol_300s"),
        "ret": F.col("close") / s.lag("close") - 1, "_one": F.when(vol.isNotNull(), 1.0)})
    d = rolling(s, d, {"_k": Frame("sum", "_one", roll), "_m": Frame("mean", "realized_vol_60s", roll)})
    d = s.close(d.withColumn("est_roll", F.when(F.col("_k") >= 30, F.col("_m"))).drop("_one", "_k", "_m"))
    d = ewm_std(d, "ret", "est_ewm")
    long = unpivot(d, ["symbol", "target"], ["est_60s", "est_300s", "est_ewm", "est_roll"], "estimator", "x")
    long = long.where((F.col("x") > 0) & (F.col("target") > 0) & finite("x"))
    g = long.groupBy("symbol", "estimator").agg(
        F.avg(F.abs(F.col("target") - F.col("x"))).alias("mae"), pearson("target", "x").alias("corr"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    best = Window.partitionBy("symbol").orderBy("mae")
    return g.withColumn("is_best", F.row_number().over(best) == 1)
