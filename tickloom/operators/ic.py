"""Information coefficients: rank correlation of signals with forward returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import finite, pearson, ratio
from tickloom.operators.fits import exponential_fits
from tickloom.operators.frames import with_position
from tickloom.operators.profile import unpivot
from tickloom.operators.ranks import average_ranks, quantiles
from tickloom.session import stage

# Fixed value: seconds of a trading year, 252 sessions of 23,400 s.
YEAR_SECONDS = 252 * 23400


def signal_pairs(df: DataFrame, keep: list[str], signals: list[str], horizons: list[int]) -> DataFrame:
    """Rows (keep, signal, x, horizon, y) with both values finite."""
    long = unpivot(df, [*keep, *[f"fwd_{h}" for h in horizons]], signals, "signal", "x")
    stack = ", ".join(f"{h}, fwd_{h}" for h in horizons)
    long = long.selectExpr(*keep, "signal", "x", f"stack({len(horizons)}, {stack}) AS (horizon, y)")
    return long.where(finite("x") & finite("y"))


def _flag(ic_above: float, hit_above: float) -> Column:
    """Whether a coefficient or a hit rate stands out. A constant signal has no coefficient, so its hit rate decides."""
    return F.coalesce(F.abs("ic") > ic_above, F.lit(False)) | F.coalesce(F.col("hit_rate") > hit_above, F.lit(False))


def ic_table(pairs: DataFrame, keys: list[str], min_obs: int = 100) -> DataFrame:
    """Spearman coefficient, hit rate and signal Sharpe per group.

    The pairs are read five times, so pass a stored or staged table.
    """
    r = pairs.join(average_ranks(pairs, keys, "x", "_rx"), [*keys, "x"]).join(
        average_ranks(pairs, keys, "y", "_ry"), [*keys, "y"])
    pnl = F.signum("x") * F.col("y")
    g = r.groupBy(*keys).agg(
        pearson("_rx", "_ry").alias("ic"),
        F.avg((F.signum("x") == F.signum("y")).cast("int")).alias("hit_rate"),
        F.avg(pnl).alias("_m"), F.stddev_samp(pnl).alias("_s"), F.count(F.lit(1)).alias("n_obs"))
    ic, n = F.col("ic"), F.col("n_obs")
    return g.where(n >= min_obs).withColumns({
        "sharpe": F.coalesce(ratio("_m", F.when(F.col("_s") > 0, F.col("_s"))), F.lit(0.0)) * math.sqrt(YEAR_SECONDS),
        "t_stat": ic * F.sqrt((n - 2) / (1 - ic * ic)),
    }).drop("_m", "_s")


def ic_stability(df: DataFrame, signals: list[str], horizon: int, block: int = 300) -> DataFrame:
    """Coefficients of consecutive full blocks of rows: mean, deviation, t; and usefulness flags."""
    ret = f"fwd_{horizon}"
    d = with_position(df.where(F.col(ret).isNotNull()), ["symbol"], "date", ["ts_sec"])
    n = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, "symbol").where("_n >= 100").withColumn("_blk", F.floor(F.col("_pos") / block))
    for c in signals:
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    d = unpivot(d, ["symbol", "_n", "_blk", ret], signals, "signal", "x").withColumnRenamed(ret, "y")
    d = stage(d, "ic-blocks")
    whole = ic_table(d, ["symbol", "signal"])
    part = ["symbol", "signal", "_blk"]

    def rank(c):
        return F.rank().over(Window.partitionBy(*part).orderBy(c)) + (
            F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1) / 2

    blocks = d.where((F.col("_blk") + 1) * block < F.col("_n"))
    blocks = blocks.withColumns({"_rx": rank("x"), "_ry": rank("y")}).groupBy(*part).agg(
        pearson("_rx", "_ry").alias("ic"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"))
    blocks = blocks.where("_sx > 1e-10 AND _sy > 1e-10").groupBy("symbol", "signal").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("_sd"), F.count(F.lit(1)).alias("n_blocks"))
    out = whole.select("symbol", "signal", "ic", "hit_rate").join(blocks, ["symbol", "signal"], "left")
    mean, sd = F.coalesce("ic_mean", "ic"), F.coalesce(F.col("_sd"), F.lit(0.01))
    return out.select(
        "symbol", "signal", "ic", "hit_rate", mean.alias("ic_mean"),
        (mean / F.greatest(sd, F.lit(0.001))).alias("ic_t"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        _flag(0.02, 0.52).alias("useful"), _flag(0.05, 0.55).alias("strong"))


def with_vol_regime(df: DataFrame, vol: str = "realized_vol_60s") -> DataFrame:
    d = df.withColumn("_v", F.coalesce(F.col(vol), F.lit(0.0)))
    q = quantiles(d, ["symbol"], "_v", {"_med": 0.5, "_p75": 0.75})
    return d.join(q, "symbol").withColumn(
        "vol_regime", F.when(F.col("_v") <= F.col("_med"), "low_vol")
        .when(F.col("_v") <= F.col("_p75"), "mid_vol").otherwise("high_vol")).drop("_v", "_med", "_p75")


def rank_signals(table: DataFrame) -> DataFrame:
    """Signals across symbols, best mean coefficient first within a horizon."""
    return table.groupBy("signal", "horizon").agg(
        F.avg("ic").alias("avg_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg("hit_rate").alias("avg_hit"),
        F.avg("sharpe").alias("avg_sharpe"), F.countDistinct("symbol").alias("n_symbols"),
        F.sum(_flag(0.02, 0.52).cast("int")).alias("n_useful"), F.sum(_flag(0.05, 0.55).cast("int")).alias("n_strong"),
    ).orderBy("horizon", F.desc("avg_ic"))


def ic_decay(table: DataFrame) -> DataFrame:
    """Half life of the coefficient over horizons by log-linear fit, weighted by ic squared."""
    w = F.col("ic") * F.col("ic")
    ly, h = F.log(F.abs("ic")), F.col("horizon")
    g = table.where("ic <> 0").groupBy("symbol", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * h).alias("sx"), F.sum(w * ly).alias("sy"),
        F.sum(w * h * h).alias("sxx"), F.sum(w * h * ly).alias("sxy"), F.max("ic").alias("peak_ic"))
    lam = -ratio(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"),
                 F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return g.where("n >= 3").select(
        "symbol", "signal", lam.alias("decay_rate"), "peak_ic",
        (F.lit(math.log(2)) / F.greatest(lam, F.lit(1e-8))).alias("half_life"))


def ic_decay_fit(table: DataFrame) -> DataFrame:
    """The decay of the coefficient's size over horizons by non-linear least squares, from the log-linear fit."""
    size = table.where("ic <> 0").select("symbol", "signal", F.col("horizon").alias("x"), F.abs("ic").alias("y"))
    start = ic_decay(table).select("symbol", "signal", F.col("peak_ic").alias("a0"), F.col("decay_rate").alias("k0"))
    d = exponential_fits(size, ["symbol", "signal"], start.withColumn("a0", F.abs("a0")))
    return d.withColumnRenamed("k", "decay_rate").withColumn(
        "half_life", F.lit(math.log(2)) / F.greatest(F.col("decay_rate"), F.lit(1e-8)))
