"""Pairs of instruments: alignment, cointegration, threshold episodes, walk-forward grading."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import pearson, ratio
from tickloom.functions.pricing import DEN, NUM
from tickloom.operators.frames import BLOCK_ROWS, span
from tickloom.session import stage

# Regression of the p-value on the unit-root statistic, constant
# term, one series (MacKinnon 1994): small and large branch, and their limits.
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
# The same for the residuals of two series.
P_SMALL_2 = (2.92, 1.5012, 0.039796)
P_LARGE_2 = (2.1945, 0.64695, -0.29198, -0.042377)
TAU_STAR_2, TAU_MIN_2, TAU_MAX_2 = -2.62, -18.86, 0.92


def sector_pairs(master: DataFrame) -> DataFrame:
    """Ordered pairs of the master's symbols that share a sector. ``master``: symbol, sector."""
    a = master.select(F.col("symbol").alias("sym1"), "sector")
    b = master.select(F.col("symbol").alias("sym2"), "sector")
    return a.join(b, "sector").where(F.col("sym1") < F.col("sym2"))


def aligned(prices: DataFrame, pairs: DataFrame, min_rows: int = 5000) -> DataFrame:
    """Rows (symbol = "a|b", date, ts_sec, y, x) on the seconds both symbols have.

    Prices meet their pair list first and then their partner by (pair, second), so the
    work is that of the listed pairs. A symbol's hot days spread over seconds.
    """
    p = prices.where(F.col("price").isNotNull())
    left = p.withColumnRenamed("symbol", "sym1").join(pairs, "sym1").select(
        "sector", "sym1", "sym2", "date", "ts_sec", F.col("price").alias("y"))
    right = p.withColumnRenamed("symbol", "sym2").join(pairs.select("sym1", "sym2"), "sym2").select(
        "sym1", "sym2", "ts_sec", F.col("price").alias("x"))
    both = left.join(right, ["sym1", "sym2", "ts_sec"])
    both = both.withColumn("symbol", F.concat_ws("|", "sym1", "sym2"))
    enough = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return both.join(enough.select("symbol"), "symbol", "left_semi")


def common_seconds(prices: DataFrame, a: str, b: str) -> DataFrame:
    """Seconds at which both series have a row."""
    return prices.where(F.col("symbol") == a).select("ts_sec").intersect(
        prices.where(F.col("symbol") == b).select("ts_sec"))


def norm_cdf(x: Column) -> Column:
    """Normal distribution function for a table of a few statistics."""
    a = F.least(F.abs(x), F.lit(7.07))

    def poly(cs):
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * a + c
        return out

    tail = F.exp(-a * a / 2) * poly(NUM) / poly(DEN)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def unit_root_pvalue(t: Column, small=P_SMALL, large=P_LARGE, star=TAU_STAR, low=TAU_MIN, high=TAU_MAX) -> Column:
    def poly(cs):
        return sum((F.lit(c) * F.pow(t, F.lit(float(i))) for i, c in enumerate(cs)), F.lit(0.0))

    inner = F.when(t <= star, norm_cdf(poly(small))).otherwise(norm_cdf(poly(large)))
    return F.when(t > high, 1.0).when(t < low, 0.0).otherwise(inner)


def hedge(rows: DataFrame) -> DataFrame:
    """Least-squares line y = ratio x + intercept of each pair."""
    return rows.groupBy("symbol", "sector", "sym1", "sym2").agg(
        F.regr_slope("y", "x").alias("hedge_ratio"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r_squared"), pearson("y", "x").alias("correlation"),
        F.avg("y").alias("_my"), F.avg("x").alias("_mx"), F.count(F.lit(1)).alias("n_bars"),
        F.countDistinct("date").alias("n_dates"))


def screen(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cointegration statistics per pair. ``rows`` (from ``aligned``) are read twice: store them first."""
    h = hedge(rows)
    d = rows.join(h.select("symbol", "hedge_ratio"), "symbol").withColumn("s", F.col("y") - F.col("hedge_ratio") * F.col("x"))
    d = stage(d.select("symbol", "date", "ts_sec", "s"), "spread")
    lvl = d.groupBy("symbol").agg(F.avg("s").alias("spread_mean"), F.stddev_pop("s").alias("spread_std"))
    sp = span(d, True, back=2, block_rows=block_rows)
    d = sp.close(sp.df.withColumns({"s1": sp.lag("s"), "s2": sp.lag("s", 2)}))
    d = d.join(lvl, "symbol").withColumns({"w": F.col("s") - F.col("s1"), "v": F.col("s1") - F.col("s2")})
    scale = F.greatest(F.col("spread_std"), F.lit(1e-8))
    z, z1 = (F.col("s") - F.col("spread_mean")) / scale, (F.col("s1") - F.col("spread_mean")) / scale

    def crossed(level):
        return F.when(F.signum(z - level) != F.signum(z1 - level), 1).otherwise(0)

    full = F.col("v").isNotNull()
    u, v, w = (F.when(full, F.col(c)) for c in ("s1", "v", "w"))
    m = d.groupBy("symbol", "spread_mean", "spread_std").agg(
        F.count(v).alias("_k"), F.var_samp(u).alias("_uu"), F.var_samp(v).alias("_vv"), F.var_samp(w).alias("_ww"),
        F.covar_samp(u, v).alias("_uv"), F.covar_samp(u, w).alias("_uw"), F.covar_samp(v, w).alias("_vw"),
        F.covar_samp("s1", "w").alias("_c"), F.var_pop(F.when(F.col("w").isNotNull(), F.col("s1"))).alias("_p"),
        F.count("w").alias("_kw"),
        F.sum(F.when(F.col("s1").isNotNull(), crossed(2) + crossed(-2)).otherwise(0)).alias("crossings"))
    det = F.col("_uu") * F.col("_vv") - F.col("_uv") * F.col("_uv")
    det = F.when(det > 0, det)
    g = (F.col("_uw") * F.col("_vv") - F.col("_vw") * F.col("_uv")) / det
    dl = (F.col("_vw") * F.col("_uu") - F.col("_uw") * F.col("_uv")) / det
    sse = (F.col("_ww") - g * F.col("_uw") - dl * F.col("_vw")) * (F.col("_k") - 1)
    se2 = sse / F.when(F.col("_k") > 3, F.col("_k") - 3) * F.col("_vv") / (det * (F.col("_k") - 1))
    phi = ratio("_c", "_p")
    m = m.withColumns({"adf_stat": g / F.sqrt(F.when(se2 > 0, se2)), "_phi": phi})
    ok = (F.col("_phi") > -1) & (F.col("_phi") < 0) & (F.col("_kw") > 100)
    m = m.withColumns({
        "pvalue": unit_root_pvalue(F.col("adf_stat")),
        "half_life": F.when(ok, -math.log(2) / F.log(F.when(ok, 1 + F.col("_phi"))))})
    out = h.join(m, "symbol")
    return out.withColumns({
        "daily_signals": F.col("crossings") / F.col("n_dates"),
        "spread_std_bps": F.col("spread_std") / ((F.col("_my") + F.col("_mx")) / 2) * 10000,
    }).select("symbol", "sector", "sym1", "sym2", "hedge_ratio", "intercept", "r_squared", "correlation", "n_bars", "n_dates",
              "adf_stat", "pvalue", "half_life", "spread_mean", "spread_std", "spread_std_bps", "daily_signals")


def residual_moments(rows: DataFrame, max_lag: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(symbol, n, gram): the products of the residual's change, its value before and its changes before that.

    ``rows`` (from ``aligned``): the residuals are those of y on x and a constant. One aggregation over blocks, which
    carry the rows that the lags reach; only rows with all ``max_lag`` changes before them count, so all lags are
    judged by the same rows.
    """
    d = rows.join(hedge(rows).select("symbol", "hedge_ratio", "intercept"), "symbol")
    d = d.withColumn("s", F.col("y") - F.col("hedge_ratio") * F.col("x") - F.col("intercept")).select("symbol", "date", "ts_sec", "s")
    sp = span(d, True, back=max_lag + 1, block_rows=block_rows)
    d = sp.close(sp.df.withColumns({f"s{i}": sp.lag("s", i) for i in range(1, max_lag + 2)}))
    d = d.where(F.col(f"s{max_lag + 1}").isNotNull())
    before = ["s", *[f"s{i}" for i in range(1, max_lag + 2)]]
    change = [F.col(a) - F.col(b) for a, b in zip(before, before[1:])]
    z = [change[0], F.col("s1"), *change[1:]]
    d = d.select("symbol", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    size = range(len(z))
    m = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{i}_{j}") for i in size for j in size if i <= j])
    return m.select("symbol", "n", F.array(*[
        F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in size]) for i in size]).alias("gram"))


def cointegration(rows: DataFrame, max_lag: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(symbol, lag, n, statistic, aic, pvalue, chosen): the two-series unit-root test of each pair for every lag.

    Regresses the residual's change on its value before and ``lag`` changes before that, without a constant, as the
    residuals have mean zero. The products of all lags are eliminated one after another, which is the Cholesky
    decomposition of the nested regressions, so all lags come from one pass over the rows. ``chosen`` is the lag of the
    least information criterion (Akaike), the smaller one on a tie. The p-value is that of two series. Pairs with too
    few rows for a lag have nulls there.
    """
    step = f"""(a, p) -> named_struct(
        's', transform(a.s, (r, i) -> transform(r, (v, j) -> v - try_divide(r[least(p, {max_lag - 1}) + 2] * a.s[least(p, {max_lag - 1}) + 2][j],
                                                                          a.s[least(p, {max_lag - 1}) + 2][least(p, {max_lag - 1}) + 2]))),
        'out', concat(a.out, array(named_struct('lag', p, 'dy', a.s[0][0], 'sy', a.s[0][1], 'ss', a.s[1][1]))))"""
    first = "named_struct('s', gram, 'out', cast(array() as array<struct<lag: int, dy: double, sy: double, ss: double>>))"
    lags = F.expr(f"aggregate(sequence(0, {max_lag}), {first}, {step}).out" if max_lag else
                  "array(named_struct('lag', 0, 'dy', gram[0][0], 'sy', gram[0][1], 'ss', gram[1][1]))")
    d = residual_moments(rows, max_lag, block_rows).select("symbol", "n", F.explode(lags).alias("l")).select("symbol", "n", "l.*")
    g = F.try_divide(F.col("sy"), F.col("ss"))
    sse = F.col("dy") - g * F.col("sy")
    free = F.col("n") - F.col("lag") - 1
    d = d.withColumns({"_g": g, "_e": F.when((sse > 0) & (free > 0), sse)})
    d = d.withColumns({
        "statistic": F.col("_g") / F.sqrt(F.col("_e") / free / F.col("ss")),
        "aic": F.col("n") * F.log(F.col("_e") / F.col("n")) + 2.0 * (F.col("lag") + 1)})
    best = d.groupBy("symbol").agg(F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "lag")))["lag"].alias("_best"))
    p = unit_root_pvalue(F.col("statistic"), P_SMALL_2, P_LARGE_2, TAU_STAR_2, TAU_MIN_2, TAU_MAX_2)
    return d.join(best, "symbol").select(
        "symbol", "lag", "n", "statistic", "aic", p.alias("pvalue"), (F.col("lag") == F.col("_best")).alias("chosen"))


def tradable(stats: DataFrame, min_half_life: float = 30, max_half_life: float = 1800, min_std_bps: float = 3.0,
             min_signals: float = 5) -> DataFrame:
    """First rule a pair fails, or ok. A missing half life means no reversion."""
    hl = F.col("half_life")
    return stats.withColumn(
        "verdict",
        F.when(hl < min_half_life, "too fast").when(hl.isNull() | (hl > max_half_life), "too slow")
        .when(F.col("spread_std_bps") < min_std_bps, "spread too small")
        .when(F.col("daily_signals") < min_signals, "too few signals")
        .when(F.col("hedge_ratio") <= 0, "negative ratio").otherwise("ok"))


def lots(stats: DataFrame, last_prices: DataFrame, lot_sizes: DataFrame, default_lot: int = 75) -> DataFrame:
    """Balanced lots: one lot of the first leg against its hedge value in the second."""
    d = stats
    for i in (1, 2):
        d = d.join(last_prices.select(F.col("symbol").alias(f"sym{i}"), F.col("price").alias(f"price{i}")), f"sym{i}")
        d = d.join(lot_sizes.select(F.col("symbol").alias(f"sym{i}"), F.col("lot_size").alias(f"lot{i}")), f"sym{i}", "left")
        d = d.withColumn(f"lot{i}", F.coalesce(f"lot{i}", F.lit(default_lot)))
    target = F.col("price1") * F.col("lot1") * F.abs("hedge_ratio") / (F.col("price2") * F.col("lot2"))
    return d.withColumns({"lots1": F.lit(1), "lots2": F.greatest(F.lit(1), F.rint(target)).cast("int")})


def zscores(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Spread and z-score of every aligned row, with the pair's own mean and deviation."""
    s = stats.select("symbol", "hedge_ratio", "spread_mean", F.greatest("spread_std", F.lit(1e-8)).alias("spread_std"))
    d = rows.join(s, "symbol").withColumn("spread", F.col("y") - F.col("hedge_ratio") * F.col("x"))
    return d.withColumn("z", (F.col("spread") - F.col("spread_mean")) / F.col("spread_std"))


def trained_zscores(rows: DataFrame, stats: DataFrame, min_train_days: int = 3, min_rows: int = 100) -> DataFrame:
    """Z-score of each day with the mean and deviation of all days before it.

    Days are reduced to (count, mean, squared deviation) and only those lines are
    scanned per pair.
    """
    d = rows.join(stats.select("symbol", "hedge_ratio"), "symbol").withColumn(
        "spread", F.col("y") - F.col("hedge_ratio") * F.col("x"))
    day = d.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("spread").alias("m"), F.var_pop("spread").alias("v"))
    day = day.withColumn("ok", F.col("n") > min_rows)
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("ok"), F.col("n"))
    train = day.select(
        "symbol", "date", "n", F.sum(n).over(w).alias("_n"), F.sum(n * F.col("m")).over(w).alias("_s"),
        F.sum(n * (F.col("v") + F.col("m") * F.col("m"))).over(w).alias("_q"),
        F.count(F.lit(1)).over(w).alias("train_days"))
    mean = F.col("_s") / F.col("_n")
    train = train.where((F.col("train_days") >= min_train_days) & (F.col("n") > min_rows) & (F.col("_n") > 0)).withColumns({
        "train_mean": mean, "train_std": F.greatest(F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))), F.lit(1e-8))})
    d = d.join(train.select("symbol", "date", "train_mean", "train_std", "train_days"), ["symbol", "date"])
    return d.withColumn("z", (F.col("spread") - F.col("train_mean")) / F.col("train_std"))


EPISODE = ("symbol string, date date, entry_z double, exit_z double, stop_z double, entry_ts long, exit_ts long, "
           "direction int, spread_change double, bars_held int, notional double, is_stop boolean, is_timeout boolean")


def _episodes(z, entry, leave, stop, max_hold):
    """(start, end, direction, stopped, timed out) of each episode of one day."""
    starts = np.flatnonzero(np.abs(z) > entry)
    i = 0
    n = len(z)
    out = []
    while True:
        k = np.searchsorted(starts, max(i, 1))
        if k == len(starts):
            return out
        a = int(starts[k])
        side = -1 if z[a] > 0 else 1
        seg = z[a + 1:a + 1 + max_hold] * -side
        hit = np.flatnonzero((seg < leave) | (seg > stop))
        if len(hit):
            b = a + 1 + int(hit[0])
        elif a + max_hold < n:
            b = a + max_hold
        else:
            return out
        out.append((a, b, side, bool(-side * z[b] > stop), b - a >= max_hold))
        i = b + 1


def threshold_episodes(scored: DataFrame, grid: list[tuple[float, float, float]], lots1: int = 1, lots2: int = 1,
                       lot_size1: int = 1, lot_size2: int = 1, max_hold: int = 1800, cost_bps: float = 9.0) -> DataFrame:
    """Episodes of a z-score from entry to exit, stop or time-out, for each threshold triple.

    ``scored``: symbol, date, ts_sec, y, x, spread, z. A task holds one pair and day, at
    most 86,400 rows. An episode still open at the end of the day is left out.
    """
    d = scored.select("symbol", "date", "ts_sec", "y", "x", "spread", "z")

    def one_day(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_sec")
        ts, y, x, s, z = (pdf[c].to_numpy() for c in ("ts_sec", "y", "x", "spread", "z"))
        rows = [
            (*key, e, l, p, int(ts[a]), int(ts[b]), side, float(s[b] - s[a]), b - a,
             float(y[a] * lots1 * lot_size1 + x[a] * lots2 * lot_size2), stopped, late)
            for e, l, p in grid for a, b, side, stopped, late in _episodes(z, e, l, p, max_hold)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EPISODE.split(", ")])

    out = d.groupBy("symbol", "date").applyInPandas(one_day, EPISODE)
    gross = F.col("direction") * F.col("spread_change") * (lots1 * lot_size1)
    return out.withColumns({"gross_pnl": gross, "cost": F.col("notional") * cost_bps / 10000}).withColumn(
        "net_pnl", F.col("gross_pnl") - F.col("cost"))


def episode_summary(episodes: DataFrame, n_dates: Column | int) -> DataFrame:
    """Results per pair and threshold triple."""
    keys = ["symbol", "entry_z", "exit_z", "stop_z"]
    day = episodes.groupBy(*keys, "date").agg(
        F.sum("net_pnl").alias("p"), F.count(F.lit(1)).alias("n"), F.sum((F.col("net_pnl") > 0).cast("int")).alias("w"),
        F.sum("bars_held").alias("b"), F.sum(F.col("is_stop").cast("int")).alias("s"),
        F.sum(F.col("is_timeout").cast("int")).alias("t"))
    n = F.sum("n")
    sd = F.stddev_samp("p")
    return day.groupBy(*keys).agg(
        n.alias("n_trades"), (F.sum("w") / n).alias("win_rate"), F.sum("p").alias("total_pnl"),
        (F.sum("p") / n_dates).alias("daily_pnl"), (F.sum("b") / n).alias("avg_hold"), (F.sum("s") / n).alias("stop_rate"),
        (F.sum("t") / n).alias("timeout_rate"),
        F.coalesce(F.avg("p") / F.when(sd > 1e-12, sd) * math.sqrt(252), F.lit(0.0)).alias("sharpe"))


def best_thresholds(summary: DataFrame, min_trades: int = 3) -> DataFrame:
    """Triple with the highest daily result x win rate per pair, among those that earn."""
    d = summary.where((F.col("n_trades") >= min_trades) & (F.col("daily_pnl") > 0)).withColumn(
        "score", F.col("daily_pnl") * F.col("win_rate"))
    w = Window.partitionBy("symbol").orderBy(F.desc("score"), "entry_z", "exit_z", "stop_z")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def grade(episodes: DataFrame, days: DataFrame, green=(1.5, 0.55), yellow=(0.8, 0.50)) -> DataFrame:
    """GREEN, YELLOW or RED per pair from out-of-sample episodes. ``days``: the tested (symbol, date)."""
    day = episodes.groupBy("symbol", "date").agg(
        F.sum("net_pnl").alias("p"), F.count(F.lit(1)).alias("n"), F.sum((F.col("net_pnl") > 0).cast("int")).alias("w"))
    d = days.select("symbol", "date").distinct().join(day, ["symbol", "date"], "left").na.fill({"p": 0.0, "n": 0, "w": 0})
    g = d.groupBy("symbol").agg(
        F.sum("n").alias("n_trades"), F.sum("p").alias("oos_pnl"), F.avg("p").alias("oos_daily"),
        F.sum("w").alias("_w"), F.stddev_pop("p").alias("_sd"), F.count(F.lit(1)).alias("_d"))
    few = F.when(F.col("oos_pnl") > 0, 10.0).otherwise(-10.0)
    g = g.withColumns({
        "win_rate": F.coalesce(ratio("_w", "n_trades"), F.lit(0.0)),
        "sharpe": F.when(F.col("n_trades") == 0, 0.0).when(F.col("_d") == 1, few).otherwise(
            F.coalesce(F.col("oos_daily") / F.when(F.col("_sd") > 1e-12, F.col("_sd")) * math.sqrt(252), F.lit(0.0)))})

    def passes(t):
        return (F.col("sharpe") >= t[0]) & (F.col("win_rate") >= t[1]) & (F.col("oos_pnl") > 0)

    return g.withColumn("grade", F.when(passes(green), "GREEN").when(passes(yellow), "YELLOW").otherwise("RED")).drop("_w", "_sd", "_d")


def sector_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("daily_pnl").alias("daily_pnl"),
        F.avg("sharpe").alias("avg_sharpe"), F.avg("win_rate").alias("avg_win_rate"))
