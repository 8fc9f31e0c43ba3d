"""Descriptive statistics of bars: distributions, time-of-day profiles, liquidity, arrivals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, finite, hhmm, ist_tod, pearson, ratio
from tickloom.operators.fits import exponential_fits
from tickloom.operators.frames import BLOCK_ROWS, span, with_position
from tickloom.operators.ranks import quantile_edges, quantiles, trim, value_ranks


def unpivot(df: DataFrame, keep: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*keep, f"stack({len(cols)}, {pairs}) AS ({name}, {value})")


def bucket_of_day(minutes: int = 15) -> Column:
    step = minutes * 60
    return hhmm(F.floor(ist_tod() / step) * step)


def day_profile(bars: DataFrame, aggs: dict[str, Column], minutes: int = 15) -> DataFrame:
    """Per (symbol, date, bucket) first, then the mean over dates: every day weighs the same."""
    per_day = (
        bars.withColumn("hhmm", bucket_of_day(minutes))
        .groupBy("symbol", "date", "hhmm").agg(*[c.alias(n) for n, c in aggs.items()])
    )
    return per_day.groupBy("symbol", "hhmm").agg(*[F.avg(n).alias(n) for n in aggs])


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    d = df.where(finite(value) & (F.col(value) > 0))
    base = d.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    q = quantiles(d, keys, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(q, keys).withColumn("cv", ratio("std", "mean"))


def day_ratio(df: DataFrame, value: str) -> DataFrame:
    """Mean per day and its ratio to the symbol's first day."""
    w = Window.partitionBy("symbol").orderBy("date")
    by_day = df.groupBy("symbol", "date").agg(F.avg(value).alias("mean"))
    return by_day.withColumn("ratio", ratio("mean", F.first("mean").over(w)))


def day_pivot(df: DataFrame, value: str, dates: list[str]) -> DataFrame:
    """One column per requested day, and the last over the first."""
    p = df.groupBy("symbol").pivot("date", dates).agg(F.avg(value))
    return p.withColumn("ratio", ratio(dates[-1], dates[0]))


def tertile_means(df: DataFrame, value: str) -> DataFrame:
    d = df.where(finite(value) & (F.col(value) > 0))
    q = quantiles(d, ["symbol"], value, {"p33": 0.33, "p66": 0.66})
    v = F.col(value)
    out = d.join(q, "symbol").groupBy("symbol", "p33", "p66").agg(
        F.avg(F.when(v <= F.col("p33"), v)).alias("mean_low"),
        F.avg(F.when((v > F.col("p33")) & (v <= F.col("p66")), v)).alias("mean_mid"),
        F.avg(F.when(v > F.col("p66"), v)).alias("mean_high"))
    r = ratio("mean_high", "mean_low")
    return out.withColumns({"high_low_ratio": r, "spread_mult": r * r})


def regime_spreads(tertiles: DataFrame, gamma: float, kappa: float) -> DataFrame:
    """Closed-form half spread at the mean volatility of each tertile."""
    tail = (2 / gamma) * math.log(1 + gamma / kappa)
    return tertiles.withColumns({
        f"spread_{n}": gamma * F.col(f"mean_{n}") * F.col(f"mean_{n}") + tail for n in ("low", "mid", "high")})


def queue_depth(bars: DataFrame, lot_size: float = 1.0) -> DataFrame:
    d = bars.withColumns({"bid_lots": F.col("bid_q1") / lot_size, "ask_lots": F.col("ask_q1") / lot_size})
    share = d.groupBy("symbol").agg(
        (F.avg((F.col("bid_lots") < 5).cast("int")) * 100).alias("pct_lt5"),
        (F.avg((F.col("bid_lots") < 10).cast("int")) * 100).alias("pct_lt10"))
    b = quantiles(d, ["symbol"], "bid_lots", {"bid_p25": 0.25, "bid_median": 0.5, "bid_p75": 0.75, "bid_p90": 0.9})
    a = quantiles(d, ["symbol"], "ask_lots", {"ask_median": 0.5})
    return share.join(b, "symbol").join(a, "symbol")


def depth_profile(bars: DataFrame, lot_size: float = 1.0) -> DataFrame:
    """Median lots at each of the ten book positions."""
    cols = [f"{s}_q{i}" for s in ("bid", "ask") for i in range(1, 6)]
    long = unpivot(bars, ["symbol"], cols, "level", "qty").withColumn("qty", F.col("qty") / lot_size)
    return quantiles(long, ["symbol", "level"], "qty", {"median_lots": 0.5})


def tick_size(bars: DataFrame, decimals: int = 4) -> DataFrame:
    """Smallest most frequent spread as tick size, and shares of one, two and more ticks."""
    d = bars.where(F.col("spread_mean") > 0).withColumn("_s", F.round("spread_mean", decimals))
    counts = d.groupBy("symbol", "_s").agg(F.count(F.lit(1)).alias("n"))
    tick = counts.groupBy("symbol").agg(F.max_by("_s", F.struct(F.col("n"), -F.col("_s"))).alias("tick"))
    s, t = F.col("_s"), F.col("tick")
    shares = counts.join(tick, "symbol").groupBy("symbol", "tick").agg(
        (F.sum(F.when(s <= t * 1.1, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("pct_1tick"),
        (F.sum(F.when((s > t * 1.1) & (s <= t * 2.1), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("pct_2tick"),
        (F.sum(F.when(s > t * 2.1, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("pct_3tick"))
    mid = quantiles(bars, ["symbol"], "close", {"mid": 0.5})
    return shares.join(mid, "symbol").withColumn("tick_bps", ratio("tick", "mid") * 10000)


def price_impact_stats(bars: DataFrame) -> DataFrame:
    t = trim(bars.where(F.col("price_impact").isNotNull()), ["symbol"], "price_impact")
    t = t.withColumn("_a", F.abs("price_impact"))
    q = quantiles(t, ["symbol"], "_a", {"median": 0.5, "_p75": 0.75, "p90": 0.9})
    high = t.join(q.select("symbol", "_p75"), "symbol").groupBy("symbol").agg(
        (F.avg((F.col("_a") > F.col("_p75")).cast("int")) * 100).alias("pct_high"))
    return q.drop("_p75").join(high, "symbol")


def signal_buckets(df: DataFrame, bins: dict[str, list[float]], horizons: list[int], far: int) -> DataFrame:
    """Forward return by fixed signal bin: right-closed bins, the lowest edge belongs to the first."""
    d = df.where(F.col(f"fwd_{far}").isNotNull())
    for s in bins:
        d = d.where(F.col(s).isNotNull())
    px = d.groupBy("symbol").agg(F.avg("close").alias("_px"))
    d = unpivot(d, ["symbol", *[f"fwd_{h}" for h in horizons]], list(bins), "signal", "x")

    def bin_of(edges):
        c = F.lit(None)
        for i in range(len(edges) - 1, 0, -1):
            low = (F.col("x") >= edges[0]) if i == 1 else (F.col("x") > edges[i - 1])
            c = F.when(low & (F.col("x") <= edges[i]), i).otherwise(c)
        return c

    b = F.lit(None)
    for s, edges in bins.items():
        b = F.when(F.col("signal") == s, bin_of(edges)).otherwise(b)
    d = d.withColumn("bin", b.cast("int")).where("bin IS NOT NULL")
    d = unpivot(d, ["symbol", "signal", "bin"], [f"fwd_{h}" for h in horizons], "horizon", "r")
    g = d.groupBy("symbol", "signal", "bin", "horizon").agg(
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n"))
    return g.join(px, "symbol").withColumns({
        "mean_pts": F.col("mean") * F.col("_px"),
        "t_stat": ratio("mean", F.col("std") / F.sqrt("n")),
    }).drop("_px")


def quantile_bins(df: DataFrame, signal: str, ret: str, bins: int = 20, min_rows: int = 5) -> DataFrame:
    """Mean and standard error of the return in equal-count bins of the signal, in bps."""
    d = df.where(finite(signal) & F.col(ret).isNotNull()).withColumn("_x", F.col(signal).cast("double"))
    edges = quantile_edges(d, ["symbol"], "_x", bins).withColumnRenamed("edges", "_edges")
    at = F.size(F.filter("_edges", lambda e: e <= F.col("_x")))
    d = d.join(edges, "symbol").withColumn("bin", at).where(F.col("bin").between(1, bins))
    return d.groupBy("symbol", "bin").agg(
        (F.avg(ret) * 10000).alias("mean_bps"),
        (F.stddev_pop(ret) * 10000 / F.sqrt(F.count(F.lit(1)))).alias("se_bps"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") > min_rows)


def correlations(df: DataFrame, signals: list[str], target: str, min_rows: int = 100,
                 positive: bool = False) -> DataFrame:
    """Pearson correlation of each signal with the target."""
    long = unpivot(df, ["symbol", target], signals, "signal", "x")
    ok = finite("x") & finite(target)
    if positive:
        ok = ok & (F.col("x") > 0) & (F.col(target) > 0)
    return (
        long.where(ok).groupBy("symbol", "signal")
        .agg(pearson("x", target).alias("corr"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_rows)
    )


def setup_test(df: DataFrame, horizons: list[int], suffix: str = "_dt") -> DataFrame:
    """Long and short results of the reversion setup, trading in the direction of the imbalance."""
    cols = [f"fwd_{h}{suffix}" for h in horizons]
    d = unpivot(df.where("reversion_setup"), ["symbol", "imbalance_dir"], cols, "horizon", "r")
    d = d.where(F.col("r").isNotNull() & (F.col("imbalance_dir") != 0))
    d = d.withColumn("pnl", F.col("imbalance_dir") * F.col("r"))
    long, short = F.col("imbalance_dir") > 0, F.col("imbalance_dir") < 0
    g = d.groupBy("symbol", "horizon").agg(
        F.count(F.when(long, 1)).alias("n_long"), F.count(F.when(short, 1)).alias("n_short"),
        F.avg(F.when(long, F.col("pnl"))).alias("long_pnl"), F.avg(F.when(short, F.col("pnl"))).alias("short_pnl"),
        F.avg("pnl").alias("all_pnl"), F.stddev_samp("pnl").alias("_sd"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"))
    return g.where((F.col("n_long") > 0) & (F.col("n_short") > 0)).withColumn(
        "t_stat", ratio("all_pnl", F.col("_sd") / F.sqrt("n"))).drop("_sd")


def interarrival(bars: DataFrame, max_gap: int = 60, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gap statistics and the distance of the gaps from an exponential law."""
    s = span(bars.select("symbol", "date", "ts_sec"), True, back=1, block_rows=block_rows)
    d = s.close(s.df.withColumn("gap", F.col("ts_sec") - s.lag("ts_sec")))
    rate = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        ratio(F.count(F.lit(1)), F.max("ts_sec") - F.min("ts_sec")).alias("rate_per_sec"))
    g = d.where((F.col("gap") > 0) & (F.col("gap") < max_gap))
    mean = g.groupBy("symbol").agg(F.avg("gap").alias("mean_gap"))
    r = value_ranks(g, ["symbol"], "gap").join(mean, "symbol")
    cdf = 1 - F.exp(-F.col("gap") / F.col("mean_gap"))
    n = F.col("total")
    ks = r.groupBy("symbol", "mean_gap", "total").agg(F.max(F.greatest(
        (F.col("below") + F.col("n")) / n - cdf, cdf - F.col("below") / n)).alias("ks_stat"))
    lam = F.sqrt(n) * F.col("ks_stat")
    p = 2 * sum(((1 if k % 2 else -1) * F.exp(-2 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    ks = ks.withColumn("ks_pvalue", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return rate.join(ks, "symbol").withColumn("is_poisson", F.col("ks_pvalue") > 0.05)


def arrival_histogram(bars: DataFrame, bins: int = 20) -> DataFrame:
    """(symbol, x, y): arrivals a second in bins of the half spread, up to its 95 % point."""
    times = bars.groupBy("symbol").agg((F.max("ts_sec") - F.min("ts_sec")).alias("_time"))
    d = bars.withColumn("_d", F.col("spread_mean") / 2).where(F.col("_d") > 0)
    d = trim(d, ["symbol"], "_d")
    lo = d.groupBy("symbol").agg(F.min("_d").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    hi = quantiles(d, ["symbol"], "_d", {"_hi": 0.95})
    edge = lo.join(hi, "symbol").join(times, "symbol").where("_n >= 20 AND _hi > _lo")
    width = (F.col("_hi") - F.col("_lo")) / bins
    d = d.join(edge, "symbol").where(F.col("_d") < F.col("_hi"))
    slot = F.least(F.floor((F.col("_d") - F.col("_lo")) / width + 1e-9), F.lit(bins - 1))
    h = d.withColumn("_bin", slot).groupBy("symbol", "_bin", "_lo", "_hi", "_time").agg(
        F.count(F.lit(1)).alias("_c"))
    x = F.col("_lo") + (F.col("_bin") + 0.5) * width
    return h.select("symbol", x.alias("x"), (F.col("_c") / F.col("_time")).alias("y"))


def arrival_decay(bars: DataFrame, bins: int = 20) -> DataFrame:
    """Decay of arrivals with the half spread: A exp(-kappa d) by weighted log regression."""
    h = arrival_histogram(bars, bins)
    w = F.col("y") * F.col("y")
    ly = F.log("y")
    g = h.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum(w).alias("sw"), F.sum(w * F.col("x")).alias("sx"),
        F.sum(w * ly).alias("sy"), F.sum(w * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(w * F.col("x") * ly).alias("sxy"), F.avg("y").alias("ybar"))
    slope = ratio(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"),
                  F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = g.where("n_bins >= 4").withColumn("kappa", clip(-slope, 0.01, 50.0))
    fit = fit.withColumn("a", F.exp((F.col("sy") + F.col("kappa") * F.col("sx")) / F.col("sw")))
    res = h.join(fit.select("symbol", "kappa", "a", "n_bins", "ybar"), "symbol").groupBy(
        "symbol", "kappa", "a", "n_bins").agg(
        F.sum(F.pow(F.col("y") - F.col("a") * F.exp(-F.col("kappa") * F.col("x")), 2.0)).alias("_res"),
        F.sum(F.pow(F.col("y") - F.col("ybar"), 2.0)).alias("_tot"))
    return res.withColumn("r2", 1 - ratio("_res", "_tot")).drop("_res", "_tot")


def arrival_fit(bars: DataFrame, bins: int = 20) -> DataFrame:
    """The same decay by non-linear least squares, which starts from the log regression: symbol, kappa, a, sse, steps,
    n_points, r2; nulls where it diverges."""
    start = arrival_decay(bars, bins).select("symbol", F.col("a").alias("a0"), F.col("kappa").alias("k0"))
    return exponential_fits(arrival_histogram(bars, bins), ["symbol"], start).withColumnRenamed("k", "kappa")


def fill_score(bars: DataFrame, minutes: int = 15) -> DataFrame:
    """Score 0-100 of each time of day: short queue, few ticks, wide spread."""
    q = bars
    for c in ("bid_q1", "tick_count", "spread_mean"):
        q = q.join(quantiles(bars, ["symbol"], c, {f"_{c}": 0.95}), "symbol")
    q = q.withColumn(
        "fill_score",
        (1 / (F.col("bid_q1") / (F.col("_bid_q1") + 1) + 0.1))
        * (1 / (F.col("tick_count") / (F.col("_tick_count") + 1) + 0.1))
        * (1 + F.col("spread_mean") / (F.col("_spread_mean") + 0.01)))
    p = day_profile(q, {"fill_score": F.avg("fill_score")}, minutes)
    w = Window.partitionBy("symbol")
    lo, hi = F.min("fill_score").over(w), F.max("fill_score").over(w)
    p = p.withColumn("score", F.when(hi > lo, (F.col("fill_score") - lo) / (hi - lo) * 100).otherwise(50.0))
    return p.withColumn("is_best", F.col("score") >= F.percentile("score", F.lit(0.75)).over(w))


def run_lengths(bars: DataFrame) -> DataFrame:
    """Runs of busy (above p75) and quiet (below p25) bars; a run still open at the end is left out."""
    d = with_position(bars.select("symbol", "date", "ts_sec", "tick_count"), ["symbol"], "date", ["ts_sec"])
    q = quantiles(d, ["symbol"], "tick_count", {"p25": 0.25, "p75": 0.75})
    end = d.groupBy("symbol").agg((F.max("_pos")).alias("_end"))
    d = d.join(q.join(end, "symbol"), "symbol").withColumn(
        "kind", F.when(F.col("tick_count") > F.col("p75"), "burst").when(F.col("tick_count") < F.col("p25"), "quiet"))
    share = d.groupBy("symbol", "p25", "p75").agg(
        (F.avg((F.col("tick_count") > F.col("p75")).cast("int")) * 100).alias("pct_burst"),
        (F.avg((F.col("tick_count") < F.col("p25")).cast("int")) * 100).alias("pct_quiet"))
    m = with_position(d.where("kind IS NOT NULL"), ["symbol", "kind"], "date", ["ts_sec"], "_k")
    runs = m.groupBy("symbol", "kind", (F.col("_pos") - F.col("_k")).alias("_run")).agg(
        F.count(F.lit(1)).alias("len"), F.max(F.col("_pos") == F.col("_end")).alias("_open"))
    runs = quantiles(runs.where("NOT _open"), ["symbol", "kind"], "len", {"median": 0.5, "p75len": 0.75})
    wide = runs.groupBy("symbol").agg(
        F.max(F.when(F.col("kind") == "burst", F.col("median"))).alias("median_burst"),
        F.max(F.when(F.col("kind") == "quiet", F.col("median"))).alias("median_quiet"),
        F.max(F.when(F.col("kind") == "burst", F.col("p75len"))).alias("p75_burst"),
        F.max(F.when(F.col("kind") == "quiet", F.col("p75len"))).alias("p75_quiet"))
    return share.join(wide, "symbol", "left")


def imbalance_hits(feats: DataFrame, signals: list[str], ahead: int = 3, level: float = 0.2,
                   min_rows: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often a signal beyond +-level calls the direction ``ahead`` rows later."""
    s = span(feats, True, ahead=ahead, block_rows=block_rows)
    d = s.close(s.df.withColumn("fwd", s.lead("close", ahead) / F.col("close") - 1))
    d = unpivot(d, ["symbol", "fwd"], signals, "signal", "x")
    side = F.when(F.col("x") > level, 1).when(F.col("x") < -level, -1).otherwise(0)
    d = d.withColumn("side", side)
    active = (F.col("side") != 0) & F.col("fwd").isNotNull()
    hit = (F.col("side") == 1) & (F.col("fwd") > 0) | (F.col("side") == -1) & (F.col("fwd") < 0)
    return d.groupBy("symbol", "signal").agg(
        (F.avg(F.when(active, hit.cast("int"))) * 100).alias("hit_pct"),
        pearson("x", "fwd").alias("corr"), F.count(F.when(active, 1)).alias("n_active"),
        (F.avg((F.col("side") != 0).cast("int")) * 100).alias("pct_active"),
    ).where(F.col("n_active") >= min_rows)


def spread_summary(bars: DataFrame) -> DataFrame:
    d = bars.where(F.col("spread_mean") > 0).withColumn("bps", F.col("spread_mean") / F.col("close") * 10000)
    q = quantiles(d, ["symbol"], "spread_mean", {"spread_p25": 0.25, "spread_median": 0.5, "spread_p75": 0.75})
    b = quantiles(d, ["symbol"], "bps", {"bps_median": 0.5})
    return q.join(b, "symbol").withColumn("min_spread_safe", F.col("spread_median") >= 0.10)
