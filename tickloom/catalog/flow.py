"""Order-flow features, labels and per-bar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import BARS, FEATS, feats, bars
from tickloom.functions import columns as fc
from tickloom.operators import features as ft

KEY = "symbol ts_sec"
_LINE = "(PARTITION BY symbol ORDER BY ts_sec)"


def _w(n):
    return f"(PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _prev(n):
    return f"(PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _full(fn, x, n):
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {fn}({x}) OVER {_w(n)} END"


def _diff(c, n=1):
    return f"coalesce({c} - lag({c}, {n}) OVER {_LINE}, 0)"


def _pos(x, default):
    return f"coalesce(CASE WHEN ({x}) > 1e-12 THEN ({x}) END, {default})"


_W = (40, 25, 15, 12, 8)
_ofi_w = " + ".join(f"{w}e-2 * ({_diff(f'bid_q{i}')} - {_diff(f'ask_q{i}')})" for i, w in enumerate(_W, 1))
_wb = " + ".join(f"{w}e-2 * bid_q{i}" for i, w in enumerate(_W, 1))
_wa = " + ".join(f"{w}e-2 * ask_q{i}" for i, w in enumerate(_W, 1))
_sgn_b = f"CASE WHEN sign({_diff('bid_p1')}) = 0 THEN 1 ELSE sign({_diff('bid_p1')}) END"
_sgn_a = f"CASE WHEN sign({_diff('ask_p1')}) = 0 THEN -1 ELSE sign({_diff('ask_p1')}) END"

FLOW = f"""{FEATS},
m0 AS (SELECT *, coalesce(weighted_mid, close) AS mid FROM feats),
m1 AS (SELECT *, ({_diff('bid_q1')}) * ({_sgn_b}) - ({_diff('ask_q1')}) * ({_sgn_a}) AS ofi_l1,
  {_ofi_w} AS ofi_weighted, ({_wb} - ({_wa})) / ({_wb} + {_wa}) AS book_imbalance_weighted,
  least(greatest(total_bid_qty / total_ask_qty, 1e-1), 10) AS qp,
  {_diff('spread_mean', 10)} AS spread_trend, {_diff('oi')} AS oi_change,
  coalesce(mid / lag(mid) OVER {_LINE} - 1, 0) AS ret,
  CASE WHEN mid > lag(mid) OVER {_LINE} THEN 1.0 ELSE 0.0 END AS up,
  coalesce(realized_vol_60s, 2) AS v60, coalesce(realized_vol_300s, 2) AS v300, coalesce(realized_vol_10s, 2) AS v10,
  row_number() OVER {_LINE} - 1 AS pos FROM m0),
m2 AS (SELECT *, lag(ret) OVER {_LINE} AS ret1, ln(qp) AS queue_pressure_log FROM m1),
m3 AS (SELECT *, ofi_l1 / {_pos(_full('stddev', 'ofi_l1', 300), 1)} AS ofi_zscore,
  coalesce({_full('sum', 'ofi_l1', 60)}, 0) AS ofi_cum_60,
  CASE WHEN pos >= 60 THEN corr(ret, ret1) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)
       ELSE 0 END AS price_autocorr_60,
  coalesce(({_full('avg', 'v60', 60)}) / ({_full('avg', 'v300', 300)}), 1) AS vol_regime_ratio,
  spread_trend / {_pos(_full('stddev', 'spread_trend', 300), 1)} AS spread_trend_z,
  coalesce({_full('avg', 'up', 60)}, 0.5) AS tick_direction_60,
  oi_change / {_pos(_full('stddev', 'oi_change', 300), 1)} AS oi_change_z FROM m2),
flow AS (SELECT *, (tick_direction_60 - 0.5) / {_pos(_full('stddev', 'tick_direction_60', 300), '1e-1')} AS tick_direction_z,
  sin(2 * pi() * ist_tod / 86400) AS ist_sin, cos(2 * pi() * ist_tod / 86400) AS ist_cos,
  least(greatest((ist_tod - 33300) / 60, 0), 375) AS mins_since_open,
  least(greatest((55800 - ist_tod) / 60, 0), 375) AS mins_to_close,
  spread_bps AS spread_rel, queue_pressure_log AS depth_ratio, (mid - vwap) / vwap AS mid_vs_vwap,
  coalesce(v10 / CASE WHEN v60 = 0 THEN 2 ELSE v60 END, 1) AS vol_ratio_10_60 FROM m3)"""


def flow(s, d):
    return ft.flow_features(feats(s, d), cross_day=True)


for _id, _cols in {
    "W10_ofi_l1": "ofi_l1:6", "W11_ofi_weighted": "ofi_weighted:6",
    "W12_ofi_zscore": "ofi_zscore:5 ofi_cum_60:5", "W13_return_autocorr": "price_autocorr_60:5",
    "W14_vol_regime_ratio": "vol_regime_ratio:6", "W15_spread_trend": "spread_trend:6 spread_trend_z:5",
    "W16_tick_direction": "tick_direction_60:6 tick_direction_z:5", "W17_oi_change_z": "oi_change:l oi_change_z:5",
    "F12_cyclical_time": "ist_sin:8 ist_cos:8 mins_since_open:6 mins_to_close:6",
    "F13_book_pressure": "queue_pressure_log:6 book_imbalance_weighted:7 mid_vs_vwap:7 vol_ratio_10_60:6",
    "C5_microstructure_features":
        "ofi_l1:6 ofi_zscore:5 spread_trend_z:5 price_mom_10s:6 spread_zscore:5 volume_ratio:6 realized_vol_60s:5 "
        "book_imbalance_weighted:7 ofi_weighted:6 tick_direction_z:5 price_autocorr_60:5 vol_regime_ratio:6 "
        "ist_sin:8 ist_cos:8 spread_rel:5 depth_ratio:6 mid_vs_vwap:7 vol_ratio_10_60:6 oi_change_z:5",
}.items():
    add(_id, flow, f"{KEY} {_cols}", f"{FLOW}\nSELECT * FROM flow")

_IM = f"""{FEATS},
i0 AS (SELECT *, coalesce(imbalance_last, 0) AS imb_simple, imbalance_last - imbalance_ma_10s AS imb_dev_10s,
  imbalance_last - imbalance_ma_30s AS imb_dev_30s, imbalance_last - imbalance_ma_60s AS imb_dev_60s,
  volume_delta / tick_count AS ofi_proxy, imbalance_last * spread_mean / 2 AS micro_vs_mid,
  coalesce(weighted_mid, close) + imbalance_last * spread_mean / 2 AS micro_price,
  total_bid_qty / (total_bid_qty + total_ask_qty) AS bid_share FROM feats),
i1 AS (SELECT *, {_diff('imb_simple')} AS imb_delta,
  CAST(abs(imb_simple) > 2 * coalesce({_full('stddev', 'imb_simple', 300)}, 1e-1) AS INTEGER) AS imb_extreme,
  least(greatest(ofi_proxy / {_pos(_full('stddev', 'ofi_proxy', 300), 1)}, -3), 3) AS ofi_norm FROM i0),
im AS (SELECT *, 4e-1 * imb_simple + 3e-1 * least(greatest(ofi_norm, -1), 1)
  + 2e-1 * least(greatest(imb_dev_30s, -1), 1) + 1e-1 * least(greatest(imb_delta, -1), 1) AS imb_combined FROM i1)"""


def imb(s, d):
    return ft.imbalance_measures(feats(s, d), cross_day=True)


add("W18_imbalance_measures", imb,
    f"{KEY} imb_dev_10s:6 imb_dev_30s:6 imb_dev_60s:6 imb_delta:6 imb_extreme:6 ofi_norm:5 bid_share:7 imb_combined:5",
    f"{_IM}\nSELECT * FROM im")
add("F14_micro_price", imb, f"{KEY} micro_price:6 micro_vs_mid:6", f"{_IM}\nSELECT * FROM im")
IMB_SQL = _IM

_z = {"impact_z": "price_impact", "volume_z": "volume_ratio", "tick_z": "tc"}
_n = {"flow_norm": "flow", "mom_norm": "mom", "imb_norm": "imbalance_last"}
_INF = f"""{FEATS},
g0 AS (SELECT *, greatest(tick_count, 1) AS tc, coalesce(price_mom_60s, 0) AS mom, volume_delta / greatest(tick_count, 1) AS flow,
  coalesce(spread_zscore, 0) AS sz, row_number() OVER {_LINE} - 1 AS pos FROM feats),
g1 AS (SELECT *, {', '.join(f"CASE WHEN pos >= 60 AND stddev_pop({c}) OVER {_prev(60)} > 1e-8 THEN ({c} - avg({c}) OVER {_prev(60)}) / stddev_pop({c}) OVER {_prev(60)} ELSE 0 END AS {n}" for n, c in _z.items())},
  {', '.join(f"CASE WHEN pos >= 60 AND max({c}) OVER {_prev(60)} - min({c}) OVER {_prev(60)} > 1e-10 THEN 2 * ({c} - min({c}) OVER {_prev(60)}) / (max({c}) OVER {_prev(60)} - min({c}) OVER {_prev(60)}) - 1 ELSE 0 END AS {n}" for n, c in _n.items())}
  FROM g0),
inf AS (SELECT *, 35e-2 * least(greatest(impact_z / 3, 0), 1) + 25e-2 * least(greatest(volume_z / 2, 0), 1)
  + 2e-1 * least(greatest(tick_z / 2, 0), 1) + 1e-1 * least(greatest(sz / 2, 0), 1)
  + 1e-1 * least(abs(imbalance_last) / 5e-1, 1) AS influence_score,
  (6e-1 * mom_norm + 25e-2 * flow_norm + 15e-2 * imb_norm) * 2e-2 AS alpha_proxy FROM g1)"""


def _influence(s, d):
    return ft.influence(feats(s, d), cross_day=True)


add("W23_influence_score", _influence,
    f"{KEY} impact_z:5 volume_z:5 tick_z:5 influence_score:6 is_influential:b p_influential:6",
    f"""{_INF}
SELECT *, influence_score >= 5e-1 AS is_influential,
  least(greatest(5e-1 * (1 + 2 * (influence_score - 5e-1)), 0), 1) AS p_influential FROM inf""")
add("W24_alpha_proxy", _influence, f"{KEY} flow_norm:6 mom_norm:6 imb_norm:6 alpha_proxy:8", f"{_INF}\nSELECT * FROM inf")

_SIG = f"""{FEATS},
s0 AS (SELECT *, coalesce(CASE WHEN realized_vol_60s > 0 THEN realized_vol_60s END, 2) AS raw,
  row_number() OVER {_LINE} - 1 AS pos FROM feats),
sg AS (SELECT *, CASE WHEN pos < 300 THEN raw ELSE avg(raw) OVER {_w(300)} END AS sigma FROM s0)"""


def _sigma(s, d):
    return ft.dynamic_sigma(feats(s, d), cross_day=True)


add("W25_dynamic_sigma", _sigma, f"{KEY} sigma:6", f"{_SIG}\nSELECT * FROM sg")
add("F10_half_spread", lambda s, d: ft.quote_spread(_sigma(s, d), 0.01, 1.5, 0.1, 50.0),
    f"{KEY} session_left:7 half_spread:5",
    f"""{_SIG}, q AS (SELECT *, greatest(60, 22500 - greatest(ts_sec % 86400 - 13500, 0)) / 22500 AS session_left,
  coalesce(weighted_mid, close) AS mid FROM sg)
SELECT *, greatest(1e-1, mid * 5e-4, least(1e-2 * sigma * sigma * session_left + (2 / 1e-2) * ln(1 + 1e-2 / 15e-1), 50)) / 2
  AS half_spread FROM q""")
add("F11_book_kappa", lambda s, d: ft.book_kappa(bars(s, d)),
    f"{KEY} kappa_buy:6 depth_buy:6 b_buy:7 kappa_sell:6 depth_sell:6 b_sell:7",
    f"""{BARS}, k AS (SELECT *, 3 / greatest(bid_q1 / 75, 1e-1) AS kappa_buy, 3 / greatest(ask_q1 / 75, 1e-1) AS kappa_sell
  FROM bars WHERE bid_q1 > 0 AND ask_q1 > 0)
SELECT *, 1 / kappa_buy AS depth_buy, 1 / kappa_sell AS depth_sell, 1 / (2 + kappa_buy) AS b_buy,
  1 / (2 + kappa_sell) AS b_sell FROM k""")
add("P7_imbalance_spike", lambda s, d: ft.imbalance_spike(feats(s, d)), f"{KEY} fake_order:b",
    f"{FEATS}\nSELECT *, abs(imbalance_last - imbalance_ma_30s) > 3e-1 AND coalesce(volume_ratio, 1) < 5e-1 AS fake_order FROM feats")
add("P13_reversion_setup", lambda s, d: ft.reversion_setup(feats(s, d)), f"{KEY} reversion_setup:b",
    f"""{FEATS}
SELECT *, abs(imbalance_last) > 2e-1 AND sign(imbalance_last) <> sign(price_mom_30s) AS reversion_setup FROM feats""")

_H = (10, 30, 60)
add("W8_forward_returns", lambda s, d: ft.forward_returns(bars(s, d), _H, cross_day=True),
    f"{KEY} fwd_10:6 fwd_30:6 fwd_60:6",
    f"{BARS}\nSELECT *, {', '.join(f'lead(close, {h}) OVER {_LINE} / close - 1 AS fwd_{h}' for h in _H)} FROM bars")
_dt = ", ".join(
    f"CASE WHEN count(fwd_{h}) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN {299 + h} PRECEDING AND {h} PRECEDING) = 300 "
    f"THEN fwd_{h} - avg(fwd_{h}) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN {299 + h} PRECEDING AND {h} PRECEDING) END AS fwd_{h}_dt"
    for h in (30, 60))
add("W9_detrended_returns", lambda s, d: ft.detrended_returns(bars(s, d), (30, 60), cross_day=True),
    f"{KEY} fwd_30:6 fwd_30_dt:5 fwd_60:6 fwd_60_dt:5",
    f"""{BARS}, f AS (SELECT *, {', '.join(f'lead(close, {h}) OVER {_LINE} - close AS fwd_{h}' for h in (30, 60))} FROM bars)
SELECT *, {_dt} FROM f""")
add("C6_direction_labels", lambda s, d: ft.direction_labels(bars(s, d), cross_day=True), f"{KEY} label:l",
    f"""{BARS}, l AS (SELECT symbol, ts_sec, lead(coalesce(weighted_mid, close), 30) OVER {_LINE} / coalesce(weighted_mid, close) - 1 AS r FROM bars)
SELECT symbol, ts_sec, CASE WHEN r > 5e-4 THEN 1 WHEN r < -5e-4 THEN -1 ELSE 0 END AS label FROM l WHERE r IS NOT NULL""")
add("F9_safe_defaults",
    lambda s, d: feats(s, d).withColumns({"vol_safe": fc.clean("realized_vol_60s", 2.0), "z_safe": fc.clean("spread_zscore", 0.0)}),
    f"{KEY} vol_safe:5 z_safe:5",
    f"{FEATS}\nSELECT *, coalesce(realized_vol_60s, 2) AS vol_safe, coalesce(spread_zscore, 0) AS z_safe FROM feats")
add("P10_finite_mask",
    lambda s, d: ft.forward_returns(imb(s, d), (5,), "log", "mid", cross_day=True)
    .where(fc.finite("imb_combined") & fc.finite("fwd_5")),
    f"{KEY} imb_combined:5 fwd_5:6",
    f"""{_IM}, r AS (SELECT *, ln(lead(coalesce(weighted_mid, close), 5) OVER {_LINE} / coalesce(weighted_mid, close)) AS fwd_5 FROM im)
SELECT * FROM r WHERE fwd_5 IS NOT NULL AND imb_combined IS NOT NULL""")
