"""Price impact per unit of volume and the toxicity derived from it."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, ratio
from tickloom.operators.frames import BLOCK_ROWS, span

REGIMES = ("LOW", "MEDIUM", "HIGH", "EXTREME")
# Advice per dominant regime.
ADVICE = {
    "LOW": "GOOD for MM — low adverse selection, tighten spread",
    "MEDIUM": "ACCEPTABLE — use base A-S spread",
    "HIGH": "CAUTION — widen spread 1.5-2x, reduce size",
    "EXTREME": "AVOID — informed flow dominant, pause MM",
}


SLICE = 1024
SHORT = 64


def _median_slopes(moves: pd.Series, volumes: pd.Series) -> pd.Series:
    """Median of the slopes between all pairs of a row's points; none without a pair of different volumes.

    The frame bounds a row's points; rows are taken some at a time as matrices.
    """
    out = np.full(len(moves), np.nan)
    sizes = moves.map(lambda x: 0 if x is None else len(x)).to_numpy()
    todo = np.flatnonzero(sizes > 1)
    for start in range(0, len(todo), SLICE):
        at = todo[start:start + SLICE]
        x, y = np.full((2, len(at), sizes[at].max()), np.nan)
        for i, k in enumerate(at):
            x[i, : sizes[k]], y[i, : sizes[k]] = volumes.iloc[k], moves.iloc[k]
        a, b = np.triu_indices(x.shape[1], 1)
        run = x[:, b] - x[:, a]
        run[~(np.abs(run) > 1e-10)] = np.nan
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # rows without a slope
            out[at] = np.nanmedian((y[:, b] - y[:, a]) / run, axis=1)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def sliding_median_slopes(y: np.ndarray, x: np.ndarray, window: int, first: int = 0) -> np.ndarray:
    """Median slope of the pairs of points among the last ``window`` rows, for each row from ``first`` on; NaN without one.

    Each pair's slope is ranked once among all of the block. A row adds the slopes of its own point and drops those of
    the point that leaves: flags by rank with counts of runs of ranks, in which the median is found. So a row costs
    its window, not the square of it; memory is that of rows times window.
    """
    n = len(y)
    back = min(window, n) - 1
    if back < 1:
        return np.full(n - first, np.nan)
    gap = np.arange(1, back + 1)
    earlier = np.arange(n)[:, None] - gap[None, :]
    known = earlier >= 0
    earlier = np.where(known, earlier, 0)
    run = x[:, None] - x[earlier]
    known &= np.abs(run) > 1e-10  # not for NaN either
    slopes = (y[:, None] - y[earlier])[known] / run[known]
    order = np.argsort(slopes, kind="stable")
    ordered = slopes[order]
    rank = np.full(known.shape, -1, dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    rank[known] = place
    size = max(16, int(len(order) ** 0.5))
    here, counts, total = np.zeros(len(order), dtype=bool), np.zeros(len(order) // size + 1, dtype=np.int64), 0

    def nth(k: int) -> float:
        upto = np.cumsum(counts)
        part = int(np.searchsorted(upto, k, side="right"))
        inside = np.flatnonzero(here[part * size:(part + 1) * size])
        return ordered[part * size + inside[k - (upto[part - 1] if part else 0)]]

    out = np.full(n, np.nan)
    for t in range(n):
        gone = t - back - 1
        if gone >= 0:
            drop = rank[gone + gap, gap - 1]
            drop = drop[drop >= 0]
            here[drop] = False
            counts -= np.bincount(drop // size, minlength=len(counts))
            total -= len(drop)
        new = rank[t][rank[t] >= 0]
        here[new] = True
        counts += np.bincount(new // size, minlength=len(counts))
        total += len(new)
        if t >= first and total:
            out[t] = (nth((total - 1) // 2) + nth(total // 2)) / 2
    return out[first:]


def _long_medians(d: DataFrame, window: int, block_rows: int) -> DataFrame:
    """(symbol, date, ts_sec, _s) by blocks of a day that carry the rows their first windows reach."""
    s = span(d.select("symbol", "date", "ts_sec", "_dp", "_sv"), back=window, block_rows=block_rows, blocks=True)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        y, x = (pdf[c].to_numpy(dtype=float) for c in ("_dp", "_sv"))
        slope = sliding_median_slopes(y, x, window)
        own = pdf["_own"].to_numpy(dtype=bool)
        out = pdf.loc[own, ["symbol", "date", "ts_sec"]]
        return out.assign(_s=pd.Series(slope[own], index=out.index).astype(object).where(~np.isnan(slope[own]), None))

    return s.df.groupBy(*s.part).applyInPandas(block, "symbol string, date date, ts_sec long, _s double")


def impact(bars: DataFrame, window: int = 30, min_bars: int = 10, signed: bool = False,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling slope without intercept, its fit, and the median of pairwise slopes, by symbol and day.

    Windows of up to SHORT rows carry their points with each row, longer ones are walked in ordered blocks.
    """
    s = span(bars)
    move = F.col("close") - s.lag("close")
    vol = F.col("volume_delta").cast("double")
    sv = F.signum(move) * vol if signed else vol
    d = s.df.withColumns({"_dp": move, "_seen": F.least(s.pos + 1, F.lit(window))})
    d = d.withColumn("_sv", F.when(F.col("_dp").isNotNull() & (sv != 0), sv))
    d = d.withColumn("_dp", F.when(F.col("_sv").isNotNull(), F.col("_dp")))
    w = s.line.rowsBetween(-(window - 2), 0)
    dp, v = F.col("_dp"), F.col("_sv")
    d = d.withColumns({
        "_n": F.count(v).over(w), "_xy": F.sum(dp * v).over(w), "_xx": F.sum(v * v).over(w),
        "_yy": F.sum(dp * dp).over(w), "_var": F.var_pop(dp).over(w),
        "avg_spread_bps": F.avg("spread_bps").over(s.last(window)),
        **({"_moves": F.collect_list(dp).over(w), "_volumes": F.collect_list(v).over(w)} if window <= SHORT else {}),
    })
    every, d = d, d.where(F.col("_seen") >= min_bars)
    ok = F.col("_n") >= min_bars // 2
    lam = ratio("_xy", "_xx")
    res = F.col("_yy") - 2 * lam * F.col("_xy") + lam * lam * F.col("_xx")
    tot = F.col("_var") * F.col("_n")
    if window <= SHORT:
        slope = F.pandas_udf(_median_slopes, "double")
        d = d.withColumn("_s", slope(F.when(ok, F.col("_moves")), F.when(ok, F.col("_volumes"))))
    else:
        d = d.join(_long_medians(every, window - 1, block_rows), ["symbol", "date", "ts_sec"], "left")
    return d.withColumns({
        "estimated": ok,
        "lambda_ols": F.when(ok, lam).otherwise(0.0),
        "r_squared": F.when(ok & (tot > 1e-12), F.greatest(F.lit(0.0), 1 - res / tot)).otherwise(0.0),
        "lambda_robust": F.when(ok, F.coalesce("_s", F.lit(0.0))).otherwise(0.0),
        "window_bars": F.col("_seen"),
    }).drop("_dp", "_sv", "_seen", "_n", "_xy", "_xx", "_yy", "_var", "_moves", "_volumes", "_s")


def _score(d: DataFrame, raw: Column) -> DataFrame:
    live = F.col("estimated") & (F.col("avg_spread_bps") > 0) & (F.col("lambda_robust") > 0)
    d = d.withColumn("toxicity", F.when(live, clip(raw, 0.0, 1.0)).otherwise(0.0))
    t = F.col("toxicity")
    return d.withColumns({
        "multiplier": F.when(F.col("estimated"), 0.5 + t * 2.5).otherwise(1.0),
        "regime": F.when(t < 0.25, "LOW").when(t < 0.5, "MEDIUM").when(t < 0.75, "HIGH").otherwise("EXTREME")})


def toxicity(lam: DataFrame, calibrate: bool = True) -> DataFrame:
    """Toxicity in 0..1: a fixed scale, or the day's quartiles of positive impact where ten exist."""
    fixed = F.least(F.col("lambda_robust") / 0.005, F.lit(1.0))
    if not calibrate:
        return _score(lam, fixed)
    r = F.round("lambda_robust", 6)
    cal = lam.where(r > 0).groupBy("symbol", "date").agg(
        F.percentile(r, F.lit(0.25)).alias("_p25"), F.percentile(r, F.lit(0.75)).alias("_p75"),
        F.count(F.lit(1)).alias("_k")).where("_k >= 10")
    d = lam.join(cal, ["symbol", "date"], "left")
    scaled = (F.col("lambda_robust") - F.col("_p25")) / (F.col("_p75") - F.col("_p25"))
    use = F.col("_p75").isNotNull() & (F.col("_p75") > F.col("_p25"))
    return _score(d, F.when(use, scaled).otherwise(fixed)).drop("_p25", "_p75", "_k")


def daily_summary(tox: DataFrame) -> DataFrame:
    """One line per symbol and day. A day holds at most 86,400 bars, so exact percentiles fit a task."""
    g = tox.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("bars_analysed"), F.avg("lambda_robust").alias("lambda_mean"),
        F.percentile("lambda_robust", F.lit(0.5)).alias("lambda_median"),
        F.percentile("lambda_robust", F.lit(0.75)).alias("lambda_p75"),
        F.percentile("lambda_robust", F.lit(0.95)).alias("lambda_p95"),
        F.avg("toxicity").alias("avg_toxicity"), F.max("toxicity").alias("max_toxicity"),
        F.avg("multiplier").alias("avg_multiplier"),
        *[F.sum((F.col("regime") == r).cast("int")).alias(f"n_{r.lower()}") for r in REGIMES])
    top = F.greatest(*[F.col(f"n_{r.lower()}") for r in REGIMES])
    dom = F.coalesce(*[F.when(F.col(f"n_{r.lower()}") == top, F.lit(r)) for r in REGIMES])
    advice = F.coalesce(*[F.when(F.col("dominant_regime") == r, F.lit(a)) for r, a in ADVICE.items()])
    return g.withColumn("dominant_regime", dom).withColumn("recommendation", advice)
