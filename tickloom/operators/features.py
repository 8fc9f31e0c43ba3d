"""Rolling features of bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import (
    clean, clip, ist_tod, mid_or_close, per_deviation, ratio, session_label,
)
from tickloom.operators.frames import BLOCK_ROWS, span
from tickloom.operators.rolling import Frame, rolling, rolling_corr

# Weights of the five book levels.
LEVEL_WEIGHTS = (0.40, 0.25, 0.15, 0.12, 0.08)

DIRECTION_FEATURES = [
    "imbalance_last", "price_mom_10s", "price_mom_30s", "price_mom_60s",
    "spread_zscore", "volume_ratio", "volume_delta", "realized_vol_60s",
    "price_impact", "tick_count", "spread_bps", "bid_q1", "ask_q1",
    "total_bid_qty", "total_ask_qty", "book_imbalance_weighted", "ofi_weighted",
    "tick_direction_z", "price_autocorr_60", "vol_regime_ratio",
    "ist_sin", "ist_cos", "mins_since_open", "mins_to_close",
    "spread_rel", "depth_ratio", "mid_vs_vwap", "vol_ratio_10_60", "oi_change_z",
]


def bar_features(bars: DataFrame, mode: str = "price", cross_day: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Volatility, imbalance means, spread z-score, volume ratio and momentum.

    ``price``: deviation of the price, frames may be partial at the start.
    ``returns``: deviation of returns times sqrt(n), full frames only.
    """
    s = span(bars, cross_day, back=301, block_rows=block_rows, blocks=True)
    if mode == "returns":
        return _return_features(s)
    frames = {f"realized_vol_{n}s": Frame("std", "close", n) for n in (10, 30, 60, 300)}
    frames |= {f"imbalance_ma_{n}s": Frame("mean", "imbalance_last", n) for n in (10, 30, 60)}
    frames |= {"_sm": Frame("mean", "spread_mean", 300), "_ss": Frame("std", "spread_mean", 300),
               "_tc": Frame("mean", "tick_count", 60)}
    d = rolling(s, s.df, frames)
    cols = {f"price_mom_{n}s": ratio(F.col("close") - s.lag("close", n), s.lag("close", n)) for n in (10, 30, 60)}
    cols["spread_zscore"] = per_deviation(F.col("spread_mean") - F.col("_sm"), F.col("_ss"))
    cols["volume_ratio"] = ratio("tick_count", F.col("_tc"))
    return s.close(d.withColumns(cols).drop("_sm", "_ss", "_tc"))


def _return_features(s) -> DataFrame:
    d = s.df.withColumn("_ret", F.col("close") / s.lag("close") - 1)
    frames = {f"_v{n}": Frame("std", "_ret", n, full=True) for n in (10, 30, 60, 300)}
    frames |= {f"imbalance_ma_{n}s": Frame("mean", "imbalance_last", n, full=True) for n in (10, 30, 60)}
    frames |= {"_sm": Frame("mean", "spread_mean", 300, full=True), "_ss": Frame("std", "spread_mean", 300, full=True),
               "_tc": Frame("mean", "tick_count", 60, full=True)}
    d = rolling(s, d, frames)
    cols = {f"realized_vol_{n}s": F.col(f"_v{n}") * math.sqrt(n) for n in (10, 30, 60, 300)}
    cols |= {f"price_mom_{n}s": F.col("close") / s.lag("close", n) - 1 for n in (10, 30, 60)}
    cols["spread_zscore"] = F.coalesce(per_deviation(F.col("spread_mean") - F.col("_sm"), F.col("_ss")), F.lit(0.0))
    cols["volume_ratio"] = F.coalesce(ratio("tick_count", F.col("_tc")), F.lit(1.0))
    return s.close(d.withColumns(cols).drop("_ret", "_sm", "_ss", "_tc", *[f"_v{n}" for n in (10, 30, 60, 300)]))


def _positive(x, default: float):
    """x, or ``default`` where x is missing or zero up to rounding."""
    return F.coalesce(F.when(F.abs(x) > 1e-12, x), F.lit(float(default)))


def flow_features(feats: DataFrame, cross_day: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Order-flow imbalance, autocorrelation, regime ratio, tick direction and model inputs."""
    s = span(feats, cross_day, back=362, block_rows=block_rows, blocks=True)

    def diff(c, n=1):
        return F.coalesce(F.col(c) - s.lag(c, n), F.lit(0.0))

    def sign_or(c, zero):
        d = F.signum(diff(c))
        return F.when(d == 0, F.lit(zero)).otherwise(d)

    def level_sum(term):
        return sum((F.lit(w) * term(i) for i, w in enumerate(LEVEL_WEIGHTS, 1)), F.lit(0.0))

    bid = level_sum(lambda i: F.coalesce(F.col(f"bid_q{i}"), F.lit(0)))
    ask = level_sum(lambda i: F.coalesce(F.col(f"ask_q{i}"), F.lit(0)))
    queue = F.coalesce(ratio(F.when(F.col("total_bid_qty") != 0, F.col("total_bid_qty")), "total_ask_qty"),
                       F.lit(1.0))
    tod = ist_tod()
    mid = F.col("_mid")
    vwap = F.coalesce(F.when(F.col("vwap") != 0, F.col("vwap")), mid)
    v60 = F.coalesce(F.col("realized_vol_60s"), F.lit(2.0))
    v10 = F.coalesce(F.col("realized_vol_10s"), F.lit(2.0))

    # first differences
    d = s.df.withColumn("_mid", mid_or_close()).withColumns({
        "ofi_l1": diff("bid_q1") * sign_or("bid_p1", 1.0) - diff("ask_q1") * sign_or("ask_p1", -1.0),
        "ofi_weighted": level_sum(lambda i: diff(f"bid_q{i}") - diff(f"ask_q{i}")),
        "queue_pressure": queue,
        "queue_pressure_log": F.log(clip(queue, 0.1, 10.0)),
        "depth_ratio": F.log(clip(queue, 0.1, 10.0)),
        "book_imbalance_weighted": (bid - ask) / F.when(bid + ask == 0, F.lit(1.0)).otherwise(bid + ask),
        "spread_trend": diff("spread_mean", 10),
        "oi_change": diff("oi"),
        "_ret": F.coalesce(ratio(mid, s.lag("_mid")) - 1, F.lit(0.0)),
        "_up": F.when(diff("_mid") > 0, 1.0).otherwise(0.0),
        "_v60": v60,
        "_v300": F.coalesce(F.col("realized_vol_300s"), F.lit(2.0)),
        "_pos0": s.pos,
        "ist_sin": F.sin(tod * (2 * math.pi / 86400)),
        "ist_cos": F.cos(tod * (2 * math.pi / 86400)),
        "mins_since_open": clip((tod - 33300) / 60, 0.0, 375.0),
        "mins_to_close": clip((F.lit(55800) - tod) / 60, 0.0, 375.0),
        "spread_rel": F.coalesce(F.col("spread_bps"), F.lit(0.0)),
        "mid_vs_vwap": (mid - vwap) / vwap,
        "vol_ratio_10_60": v10 / F.when(v60 == 0, F.lit(2.0)).otherwise(v60),
    })
    # frames over the differences
    d = rolling(s, d.withColumn("_ret1", s.lag("_ret")), {
        "_so": Frame("std", "ofi_l1", 300, full=True), "_co": Frame("sum", "ofi_l1", 60, full=True),
        "_sr": Frame("stdp", "_ret", 60, 1), "_m60": Frame("mean", "_v60", 60, full=True),
        "_m300": Frame("mean", "_v300", 300, full=True), "_st": Frame("std", "spread_trend", 300, full=True),
        "_td": Frame("mean", "_up", 60, full=True), "_soi": Frame("std", "oi_change", 300, full=True)})
    d = rolling_corr(s, d, "_ac", "_ret", "_ret1", 59, 1)
    d = d.withColumns({
        "ofi_zscore": F.col("ofi_l1") / _positive(F.col("_so"), 1),
        "ofi_cum_60": F.coalesce("_co", F.lit(0.0)),
        "price_autocorr_60": F.when(
            (F.col("_pos0") >= 60) & (F.col("_sr") > 1e-10), F.coalesce("_ac", F.lit(0.0))).otherwise(0.0),
        "vol_regime_ratio": F.coalesce(
            F.col("_m60") / F.when(F.col("_m300") == 0, F.lit(2.0)).otherwise(F.col("_m300")), F.lit(1.0)),
        "spread_trend_z": F.col("spread_trend") / _positive(F.col("_st"), 1),
        "tick_direction_60": F.coalesce("_td", F.lit(0.5)),
        "oi_change_z": F.col("oi_change") / _positive(F.col("_soi"), 1),
    })
    d = rolling(s, d, {"_std": Frame("std", "tick_direction_60", 300, full=True)})
    d = d.withColumn("tick_direction_z", (F.col("tick_direction_60") - 0.5) / _positive(F.col("_std"), 0.1))
    return s.close(d.drop("_mid", "_ret", "_ret1", "_up", "_v60", "_v300", "_pos0", "_so", "_co", "_sr", "_m60", "_m300",
                          "_st", "_td", "_soi", "_ac", "_std"))


def imbalance_measures(feats: DataFrame, cross_day: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deviation, change, extreme flag, flow proxy, micro-price and the weighted composite."""
    s = span(feats, cross_day, back=302, block_rows=block_rows, blocks=True)
    imb = F.coalesce(F.col("imbalance_last"), F.lit(0.0))
    mid = mid_or_close()
    d = s.df.withColumns({
        "imb_simple": imb,
        "imb_mean": F.coalesce(F.col("imbalance_mean"), F.lit(0.0)),
        **{f"imb_dev_{n}s": imb - F.coalesce(F.col(f"imbalance_ma_{n}s"), F.lit(0.0)) for n in (10, 30, 60)},
        "ofi_proxy": F.coalesce(F.col("volume_delta"), F.lit(0)) / _positive(F.col("tick_count"), 1),
        "micro_price": mid + imb * F.coalesce(F.col("spread_mean"), F.lit(0.1)) / 2,
        "bid_share": F.coalesce(
            ratio(F.coalesce(F.col("total_bid_qty"), F.lit(0)),
                  F.coalesce(F.col("total_bid_qty"), F.lit(0)) + F.coalesce(F.col("total_ask_qty"), F.lit(0))),
            F.lit(0.5)),
        "session": session_label(ist_tod()),
    })
    d = rolling(s, d, {"_si": Frame("std", "imb_simple", 300, full=True), "_so": Frame("std", "ofi_proxy", 300, full=True)})
    d = d.withColumns({
        "imb_delta": F.coalesce(F.col("imb_simple") - s.lag("imb_simple"), F.lit(0.0)),
        "imb_extreme": (F.abs("imb_simple") > 2 * F.coalesce("_si", F.lit(0.1)))
        .cast("double"),
        "ofi_norm": clip(F.col("ofi_proxy") / _positive(F.col("_so"), 1), -3.0, 3.0),
        "micro_vs_mid": F.col("micro_price") - mid,
    })
    d = d.withColumn(
        "imb_combined",
        0.40 * F.col("imb_simple") + 0.30 * clip("ofi_norm", -1.0, 1.0)
        + 0.20 * clip("imb_dev_30s", -1.0, 1.0) + 0.10 * clip("imb_delta", -1.0, 1.0))
    return s.close(d.drop("_si", "_so"))


def influence(feats: DataFrame, window: int = 60, rho: float = 0.5, cross_day: bool = False,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Influence score from z-scores against the rows before a bar, and the alpha composite."""
    s = span(feats, cross_day, back=window + 1, block_rows=block_rows, blocks=True)
    base = s.df.withColumns({
        "_impact": F.abs(clean("price_impact", 0)),
        "_vr": clean("volume_ratio", 1),
        "_tc": F.greatest(clean("tick_count", 1), F.lit(1.0)),
        "_mom": clean("price_mom_60s", 0),
        "_imb": clean("imbalance_last", 0),
        "_sz": clean("spread_zscore", 0),
        "_pos0": s.pos,
    }).withColumn("_flow", clean("volume_delta", 0) / F.col("_tc"))
    ready = F.col("_pos0") >= window

    frames = {}
    for c in ("_impact", "_vr", "_tc"):
        frames |= {f"{c}_m": Frame("mean", c, window, 1), f"{c}_s": Frame("stdp", c, window, 1)}
    for c in ("_flow", "_mom", "_imb"):
        frames |= {f"{c}_lo": Frame("min", c, window, 1), f"{c}_hi": Frame("max", c, window, 1)}
    base = rolling(s, base, frames)

    def z(c):
        sd = F.col(f"{c}_s")
        return F.when(ready & (sd > 1e-8), (F.col(c) - F.col(f"{c}_m")) / F.when(sd > 1e-8, sd)).otherwise(0.0)

    def scaled(c):
        lo, width = F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")
        return F.when(ready & (width > 1e-10), 2 * (F.col(c) - lo) / F.when(width > 1e-10, width) - 1).otherwise(0.0)

    d = base.withColumns({
        "impact_z": z("_impact"), "volume_z": z("_vr"), "tick_z": z("_tc"),
        "flow_norm": scaled("_flow"), "mom_norm": scaled("_mom"), "imb_norm": scaled("_imb"),
    }).withColumns({
        "influence_score":
            0.35 * clip(F.col("impact_z") / 3, 0.0, 1.0) + 0.25 * clip(F.col("volume_z") / 2, 0.0, 1.0)
            + 0.20 * clip(F.col("tick_z") / 2, 0.0, 1.0) + 0.10 * clip(F.col("_sz") / 2, 0.0, 1.0)
            + 0.10 * clip(F.abs("_imb") / 0.5, 0.0, 1.0),
        "alpha_proxy":
            (0.60 * F.col("mom_norm") + 0.25 * F.col("flow_norm") + 0.15 * F.col("imb_norm")) * 0.02,
    }).withColumns({
        "is_influential": F.col("influence_score") >= rho,
        "p_influential": clip(F.lit(rho) * (1 + 2 * (F.col("influence_score") - 0.5)), 0.0, 1.0),
    })
    return s.close(d.drop("_impact", "_vr", "_tc", "_mom", "_imb", "_sz", "_flow", "_pos0", *frames))


def dynamic_sigma(feats: DataFrame, window: int = 300, floor: float = 2.0, cross_day: bool = False,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the 60-row volatility; the raw value for the first ``window`` rows."""
    s = span(feats, cross_day, back=window + 1, block_rows=block_rows, blocks=True)
    raw = F.coalesce(F.when(F.col("realized_vol_60s") > 0, F.col("realized_vol_60s")), F.lit(floor))
    d = s.df.withColumns({"_raw": raw, "_pos0": s.pos})
    d = rolling(s, d, {"_mean": Frame("mean", "_raw", window)})
    d = d.withColumn("sigma", F.when(F.col("_pos0") < window, F.col("_raw")).otherwise(F.col("_mean")))
    d = d.withColumn("sigma", F.when(F.col("sigma") <= 0, F.lit(floor)).otherwise(F.col("sigma")))
    return s.close(d.drop("_raw", "_pos0", "_mean"))


def imbalance_spike(feats: DataFrame) -> DataFrame:
    return feats.withColumn(
        "fake_order",
        (F.abs(F.coalesce(F.col("imbalance_last"), F.lit(0.0))
               - F.coalesce(F.col("imbalance_ma_30s"), F.lit(0.0))) > 0.3)
        & (F.coalesce(F.col("volume_ratio"), F.lit(1.0)) < 0.5))


def forward_returns(bars: DataFrame, horizons=(10, 30, 60, 300), kind: str = "simple",
                    price: str = "close", cross_day: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fwd_{h}: simple, log or point change h rows ahead."""
    s = span(bars, cross_day, ahead=max(horizons), block_rows=block_rows)
    p = mid_or_close() if price == "mid" else F.col(price)
    d = s.df.withColumn("_px", p)
    px = F.col("_px")
    made = {
        "simple": lambda nxt: ratio(nxt, px) - 1,
        "log": lambda nxt: F.when((nxt > 0) & (px > 0), F.log(nxt / px)),
        "points": lambda nxt: nxt - px,
    }[kind]
    d = d.withColumns({f"fwd_{h}": made(s.lead("_px", h)) for h in horizons})
    return s.close(d.drop("_px"))


def detrended_returns(bars: DataFrame, horizons=(30, 60, 300), window: int = 300,
                      detrend: str = "lagged", cross_day: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Point changes minus their rolling mean.

    ``lagged`` takes the mean of changes already known at the bar; ``reference``
    takes the mean up to the bar itself, which looks h rows ahead.
    """
    far = max(horizons)
    s = span(bars, cross_day, back=window + far + 1, ahead=far, block_rows=block_rows, blocks=True)
    d = s.df.withColumns({f"fwd_{h}": s.lead("close", h) - F.col("close") for h in horizons})
    d = rolling(s, d, {
        f"_m{h}": Frame("mean", f"fwd_{h}", window, h if detrend == "lagged" else 0, full=True) for h in horizons})
    d = d.withColumns({f"fwd_{h}_dt": F.col(f"fwd_{h}") - F.col(f"_m{h}") for h in horizons})
    return s.close(d.drop(*[f"_m{h}" for h in horizons]))


def direction_labels(bars: DataFrame, horizon: int = 30, threshold: float = 0.0005,
                     cross_day: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """-1, 0 or +1 by the relative change ``horizon`` rows ahead; the last rows have no label."""
    d = forward_returns(bars, (horizon,), "simple", "mid", cross_day, block_rows)
    r = F.col(f"fwd_{horizon}")
    lab = F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0)
    return d.where(r.isNotNull()).withColumn("label", lab.cast("tinyint"))


def reversion_setup(feats: DataFrame, strong: float = 0.2) -> DataFrame:
    """Strong imbalance that disagrees with the 30-row momentum."""
    return feats.withColumns({
        "imbalance_dir": F.signum("imbalance_last"),
        "mom_dir": F.signum("price_mom_30s"),
    }).withColumn(
        "reversion_setup",
        (F.abs("imbalance_last") > strong) & (F.col("imbalance_dir") != F.col("mom_dir")))


def quote_spread(df: DataFrame, gamma: float, kappa: float, min_spread: float, max_spread: float,
                 sigma: str = "sigma") -> DataFrame:
    """Closed-form spread around the mid at zero inventory, with a 5-bps floor."""
    elapsed = F.greatest(F.col("ts_sec") % 86400 - 13500, F.lit(0))
    frac = F.greatest(F.lit(60), F.lit(22500) - elapsed) / 22500.0
    raw = gamma * F.col(sigma) * F.col(sigma) * F.col("session_left") + (2.0 / gamma) * math.log(1 + gamma / kappa)
    floor = F.greatest(F.lit(min_spread), F.col("mid") * 0.0005)
    return df.withColumns({"session_left": frac, "mid": mid_or_close()}).withColumn(
        "half_spread", F.greatest(floor, F.least(raw, F.lit(max_spread))) / 2)


def book_kappa(bars: DataFrame, theta: float = 1.5, lot_size: float = 75.0) -> DataFrame:
    """Arrival decay implied by the best queues, with its depth and curvature."""
    out = bars.where((F.col("bid_q1") > 0) & (F.col("ask_q1") > 0))
    for side, q in (("buy", "bid_q1"), ("sell", "ask_q1")):
        lots = F.col(q) / lot_size
        k = F.col(f"kappa_{side}")
        out = out.withColumn(f"kappa_{side}", theta * 2.0 / F.greatest(lots, F.lit(0.1))).withColumns({
            f"depth_{side}": 1.0 / F.greatest(k, F.lit(1e-6)),
            f"b_{side}": 1.0 / (2.0 + k),
        })
    return out
