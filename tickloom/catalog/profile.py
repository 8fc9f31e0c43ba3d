"""Descriptive reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.flow import FLOW
from tickloom.catalog.standin import BARS, FEATS, TICKS, bars, bars_cte, feats
from tickloom.operators import features as ft
from tickloom.operators import fits
from tickloom.operators import profile as pf
from tickloom.operators import ranks as rk
from tickloom.plans import reports as rp
from tickloom.session import stage

_LINE = "(PARTITION BY symbol ORDER BY ts_sec)"


def hm(step):
    return f"printf('%02d:%02d', ist_tod // 3600, ist_tod % 3600 // {step} * {step // 60})"


add("P9_outlier_trim", lambda s, d: rk.trim(bars(s, d), ["symbol"], "price_impact"),
    "symbol ts_sec price_impact:7",
    f"""{BARS}, q AS (SELECT symbol, quantile_cont(abs(price_impact), 0.99) AS c FROM bars GROUP BY symbol)
SELECT b.* FROM bars b JOIN q USING (symbol) WHERE abs(price_impact) < c""")
add("A4_day_profile",
    lambda s, d: pf.day_profile(feats(s, d), {
        "vol": F.avg("realized_vol_60s"), "ticks": F.sum("tick_count"), "queue": F.avg("bid_q1"),
        "n": F.count(F.lit(1))}, 30),
    "symbol hhmm vol:5 ticks:6 queue:6 n:6",
    f"""{FEATS}, p AS (SELECT symbol, date, {hm(1800)} AS hhmm, avg(realized_vol_60s) AS vol, sum(tick_count) AS ticks,
  avg(bid_q1) AS queue, count(*) AS n FROM feats GROUP BY 1, 2, 3)
SELECT symbol, hhmm, avg(vol) AS vol, avg(ticks) AS ticks, avg(queue) AS queue, avg(n) AS n FROM p GROUP BY 1, 2""")
_DIST = f"""{FEATS}, v AS (SELECT symbol, realized_vol_60s AS v FROM feats WHERE realized_vol_60s > 0),
dist AS (SELECT symbol, avg(v) AS mean, stddev(v) AS std, min(v) AS min, max(v) AS max, count(*) AS n,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75,
  stddev(v) / avg(v) AS cv FROM v GROUP BY symbol)"""
add("A5_distribution", lambda s, d: pf.distribution(feats(s, d), ["symbol"], "realized_vol_60s"),
    "symbol mean:6 std:6 min:6 max:6 n:l p25:6 median:6 p75:6 cv:6", f"{_DIST}\nSELECT * FROM dist")
add("A6_day_ratio", lambda s, d: pf.day_ratio(feats(s, d), "realized_vol_60s"), "symbol date:d mean:5 ratio:5",
    f"""{FEATS}, m AS (SELECT symbol, date, avg(realized_vol_60s) AS mean FROM feats GROUP BY 1, 2)
SELECT symbol, date, mean, mean / first_value(mean) OVER (PARTITION BY symbol ORDER BY date) AS ratio FROM m""")
_TERT = f"""{FEATS}, v AS (SELECT symbol, realized_vol_60s AS v FROM feats WHERE realized_vol_60s > 0),
q AS (SELECT symbol, quantile_cont(v, 0.33) AS p33, quantile_cont(v, 0.66) AS p66 FROM v GROUP BY symbol),
t AS (SELECT symbol, p33, p66, avg(v) FILTER (v <= p33) AS mean_low, avg(v) FILTER (v > p33 AND v <= p66) AS mean_mid,
  avg(v) FILTER (v > p66) AS mean_high FROM v JOIN q USING (symbol) GROUP BY ALL),
tert AS (SELECT *, mean_high / mean_low AS high_low_ratio, (mean_high / mean_low) * (mean_high / mean_low) AS spread_mult,
  1e-2 * mean_low * mean_low + 200 * ln(1 + 1e-2 / 15e-1) AS spread_low,
  1e-2 * mean_high * mean_high + 200 * ln(1 + 1e-2 / 15e-1) AS spread_high FROM t)"""


def _tert(s, d):
    return pf.tertile_means(feats(s, d), "realized_vol_60s")


add("A7_tertile_regimes", _tert,
    "symbol p33:5 p66:5 mean_low:5 mean_mid:5 mean_high:5 high_low_ratio:5 spread_mult:5", f"{_TERT}\nSELECT * FROM tert")
add("A8_queue_depth", lambda s, d: pf.queue_depth(bars(s, d), 5.0),
    "symbol pct_lt5:6 pct_lt10:6 bid_p25:6 bid_median:6 bid_p75:6 bid_p90:6 ask_median:6",
    f"""{BARS}
SELECT symbol, avg(CAST(bid_q1 / 5 < 5 AS INTEGER)) * 100 AS pct_lt5, avg(CAST(bid_q1 / 5 < 10 AS INTEGER)) * 100 AS pct_lt10,
  quantile_cont(bid_q1 / 5, 0.25) AS bid_p25, quantile_cont(bid_q1 / 5, 0.5) AS bid_median,
  quantile_cont(bid_q1 / 5, 0.75) AS bid_p75, quantile_cont(bid_q1 / 5, 0.9) AS bid_p90,
  quantile_cont(ask_q1 / 5, 0.5) AS ask_median FROM bars GROUP BY symbol""")
_lv = " UNION ALL ".join(f"SELECT symbol, '{s}_q{i}' AS level, CAST({s}_q{i} AS DOUBLE) AS qty FROM bars"
                         for s in ("bid", "ask") for i in range(1, 6))
add("A9_depth_profile", lambda s, d: pf.depth_profile(bars(s, d)), "symbol level median_lots:6",
    f"{BARS}, lv AS ({_lv})\nSELECT symbol, level, quantile_cont(qty, 0.5) AS median_lots FROM lv GROUP BY 1, 2")
_TICK = f"""{BARS}, sp AS (SELECT symbol, round(spread_mean, 4) AS s FROM bars WHERE spread_mean > 0),
c AS (SELECT symbol, s, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, s) AS rn FROM sp GROUP BY 1, 2),
tk AS (SELECT symbol, s AS tick FROM c WHERE rn = 1),
md AS (SELECT symbol, quantile_cont(close, 0.5) AS mid FROM bars GROUP BY 1),
tick AS (SELECT symbol, tick, 100e0 * sum(n) FILTER (s <= tick * 11e-1) / sum(n) AS pct_1tick,
  coalesce(100e0 * sum(n) FILTER (s > tick * 11e-1 AND s <= tick * 21e-1) / sum(n), 0) AS pct_2tick,
  coalesce(100e0 * sum(n) FILTER (s > tick * 21e-1) / sum(n), 0) AS pct_3tick, mid, tick / mid * 10000 AS tick_bps
  FROM c JOIN tk USING (symbol) JOIN md USING (symbol) GROUP BY symbol, tick, mid)"""
add("A10_tick_size", lambda s, d: pf.tick_size(bars(s, d)),
    "symbol tick:4 pct_1tick:6 pct_2tick:6 pct_3tick:6 mid:6 tick_bps:5", f"{_TICK}\nSELECT * FROM tick")
add("A11_price_impact", lambda s, d: pf.price_impact_stats(bars(s, d)), "symbol median:7 p90:7 pct_high:6",
    f"""{BARS}, q AS (SELECT symbol, quantile_cont(price_impact, 0.99) AS c FROM bars GROUP BY symbol),
t AS (SELECT symbol, price_impact AS a FROM bars JOIN q USING (symbol) WHERE price_impact < c),
m AS (SELECT symbol, quantile_cont(a, 0.5) AS median, quantile_cont(a, 0.75) AS p75, quantile_cont(a, 0.9) AS p90 FROM t GROUP BY 1)
SELECT symbol, median, p90, avg(CAST(a > p75 AS INTEGER)) * 100 AS pct_high FROM t JOIN m USING (symbol) GROUP BY 1, 2, 3""")

_BINS = {"imbalance_last": [-1, -0.5, -0.2, 0.2, 0.5, 1], "price_mom_30s": [-2, -0.5, -0.1, 0.1, 0.5, 2],
         "volume_ratio": [0, 0.5, 0.8, 1.2, 2.0, 10]}


def _case(x, edges):
    out = "CASE "
    for i in range(1, len(edges)):
        low = ">=" if i == 1 else ">"
        out += f"WHEN {x} {low} {edges[i - 1]}::DOUBLE AND {x} <= {edges[i]}::DOUBLE THEN {i} "
    return out + "END"


_fw = ", ".join(f"lead(close, {h}) OVER {_LINE} / close - 1 AS fwd_{h}" for h in (10, 30, 60))
_sb = " UNION ALL ".join(
    f"SELECT symbol, '{s}' AS signal, {_case(s, e)} AS bin, 'fwd_{h}' AS horizon, fwd_{h} AS r FROM f"
    for s, e in _BINS.items() for h in (10, 30, 60))
add("A12_signal_buckets",
    lambda s, d: pf.signal_buckets(ft.forward_returns(feats(s, d), (10, 30, 60), cross_day=True), _BINS, [10, 30, 60], 60),
    "symbol signal bin:l horizon mean:5 std:4 n:l mean_pts:4 t_stat:5",
    f"""{FEATS}, f0 AS (SELECT *, {_fw} FROM feats),
f AS (SELECT * FROM f0 WHERE fwd_60 IS NOT NULL AND imbalance_last IS NOT NULL AND price_mom_30s IS NOT NULL AND volume_ratio IS NOT NULL),
px AS (SELECT symbol, avg(close) AS px FROM f GROUP BY 1), l AS ({_sb}),
g AS (SELECT symbol, signal, bin, horizon, avg(r) AS mean, stddev(r) AS std, count(r) AS n FROM l WHERE bin IS NOT NULL GROUP BY ALL)
SELECT g.*, mean * px AS mean_pts, mean / (std / sqrt(n)) AS t_stat FROM g JOIN px USING (symbol)""")
add("A13_quantile_bins",
    lambda s, d: pf.quantile_bins(
        ft.forward_returns(ft.flow_features(feats(s, d), cross_day=True), (10,), "log", cross_day=True)
        .withColumn("ofi", F.round("ofi_weighted", 9)), "ofi", "fwd_10"),
    "symbol bin:l mean_bps:4 se_bps:4 n:l",
    f"""{FLOW}, f AS (SELECT symbol, round(ofi_weighted, 9) AS x, ln(lead(close, 10) OVER {_LINE} / close) AS r FROM flow),
e AS (SELECT symbol, quantile_cont(x, {[round(i / 20, 2) for i in range(21)]}) AS es FROM f WHERE r IS NOT NULL GROUP BY 1),
b AS (SELECT symbol, len(list_filter(es, lambda v: v <= x)) AS bin, r FROM f JOIN e USING (symbol) WHERE r IS NOT NULL)
SELECT symbol, bin, avg(r) * 10000 AS mean_bps, stddev_pop(r) * 10000 / sqrt(count(*)) AS se_bps, count(*) AS n
FROM b WHERE bin BETWEEN 1 AND 20 GROUP BY 1, 2 HAVING count(*) > 5""")
add("A14_signal_correlations",
    lambda s, d: pf.correlations(ft.forward_returns(feats(s, d), (60,), cross_day=True),
                                 ["imbalance_last", "price_mom_30s", "volume_ratio", "realized_vol_60s", "spread_zscore"], "fwd_60"),
    "symbol signal corr:6 n:l",
    f"""{FEATS}, f AS (SELECT *, lead(close, 60) OVER {_LINE} / close - 1 AS y FROM feats),
l AS (UNPIVOT (SELECT symbol, y, imbalance_last, price_mom_30s, volume_ratio, realized_vol_60s, spread_zscore FROM f)
  ON imbalance_last, price_mom_30s, volume_ratio, realized_vol_60s, spread_zscore INTO NAME signal VALUE x)
SELECT symbol, signal, corr(x, y) AS corr, count(*) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100""")

_w300 = "(PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)"
add("A19_setup_test",
    lambda s, d: pf.setup_test(ft.reversion_setup(ft.detrended_returns(feats(s, d), (30, 60), detrend="reference", cross_day=True)), [30, 60]),
    "symbol horizon n_long:l n_short:l long_pnl:7 short_pnl:7 all_pnl:7 win_rate:6 t_stat:5 n:l",
    f"""{FEATS}, f AS (SELECT *, {', '.join(f'lead(close, {h}) OVER {_LINE} - close AS f{h}' for h in (30, 60))} FROM feats),
g AS (SELECT *, {', '.join(f'CASE WHEN count(f{h}) OVER {_w300} = 300 THEN f{h} - avg(f{h}) OVER {_w300} END AS d{h}' for h in (30, 60))} FROM f),
l AS ({' UNION ALL '.join(f"SELECT symbol, 'fwd_{h}_dt' AS horizon, sign(imbalance_last) AS side, sign(imbalance_last) * d{h} AS pnl FROM g WHERE abs(imbalance_last) > 2e-1 AND sign(imbalance_last) <> sign(price_mom_30s) AND d{h} IS NOT NULL" for h in (30, 60))})
SELECT symbol, horizon, count(*) FILTER (side > 0) AS n_long, count(*) FILTER (side < 0) AS n_short,
  avg(pnl) FILTER (side > 0) AS long_pnl, avg(pnl) FILTER (side < 0) AS short_pnl, avg(pnl) AS all_pnl,
  avg(CAST(pnl > 0 AS INTEGER)) AS win_rate, avg(pnl) / (stddev(pnl) / sqrt(count(*))) AS t_stat, count(*) AS n
FROM l GROUP BY 1, 2 HAVING count(*) FILTER (side > 0) > 0 AND count(*) FILTER (side < 0) > 0""".replace("\nSELECT symbol, horizon, count(*) FILTER", "\nSELECT symbol, horizon, count(*) FILTER"))

_GAP = f"""WITH {TICKS}, {bars_cte(600)}, g0 AS (SELECT symbol, ts_sec, ts_sec - lag(ts_sec) OVER {_LINE} AS gap FROM bars),
rt AS (SELECT symbol, count(*) AS n_bars, count(*)::DOUBLE / (max(ts_sec) - min(ts_sec)) AS rate_per_sec FROM g0 GROUP BY 1),
g AS (SELECT symbol, gap FROM g0 WHERE gap > 0 AND gap < 7200),
m AS (SELECT symbol, avg(gap) AS mean_gap, count(*) AS total FROM g GROUP BY 1),
e AS (SELECT symbol, gap, cume_dist() OVER (PARTITION BY symbol ORDER BY gap) AS hi,
  (rank() OVER (PARTITION BY symbol ORDER BY gap) - 1)::DOUBLE / count(*) OVER (PARTITION BY symbol) AS lo FROM g),
ks AS (SELECT symbol, mean_gap, total, max(greatest(hi - (1 - exp(-gap / mean_gap)), (1 - exp(-gap / mean_gap)) - lo)) AS ks_stat
  FROM e JOIN m USING (symbol) GROUP BY 1, 2, 3),
arr AS (SELECT symbol, n_bars, rate_per_sec, mean_gap, ks_stat, least(greatest(2 * ({' '.join(f"{'+' if k % 2 else '-'} exp(-{2 * k * k} * total * ks_stat * ks_stat)" for k in range(1, 21))}), 0), 1) AS ks_pvalue
  FROM rt JOIN ks USING (symbol))"""
_gap = lambda s, d: pf.interarrival(bars(s, d, 600), 7200)
add("A23_interarrival", _gap, "symbol n_bars:l rate_per_sec:8 mean_gap:4 ks_stat:6 ks_pvalue:6 is_poisson:b",
    f"{_GAP}\nSELECT *, ks_pvalue > 5e-2 AS is_poisson FROM arr")
_KAP = f"""{BARS}, tm AS (SELECT symbol, max(ts_sec) - min(ts_sec) AS tt FROM bars GROUP BY 1),
d0 AS (SELECT symbol, spread_mean / 2 AS d FROM bars WHERE spread_mean > 0),
c AS (SELECT symbol, quantile_cont(d, 0.99) AS c FROM d0 GROUP BY 1), d1 AS (SELECT symbol, d FROM d0 JOIN c USING (symbol) WHERE d < c),
e AS (SELECT symbol, min(d) AS lo, quantile_cont(d, 0.95) AS hi FROM d1 GROUP BY 1 HAVING count(*) >= 20),
h AS (SELECT symbol, lo + (least(floor((d - lo) / ((hi - lo) / 20) + 1e-9), 19) + 0.5) * ((hi - lo) / 20) AS x, count(*) / any_value(tt)::DOUBLE AS y
  FROM d1 JOIN e USING (symbol) JOIN tm USING (symbol) WHERE d < hi GROUP BY 1, 2),
s AS (SELECT symbol, count(*) AS n_bins, sum(y*y) AS sw, sum(y*y*x) AS sx, sum(y*y*ln(y)) AS sy, sum(y*y*x*x) AS sxx,
  sum(y*y*x*ln(y)) AS sxy, avg(y) AS yb FROM h GROUP BY 1 HAVING count(*) >= 4),
k AS (SELECT *, least(greatest(-(sw * sxy - sx * sy) / (sw * sxx - sx * sx), 1e-2), 50) AS kappa FROM s),
k2 AS (SELECT *, exp((sy + kappa * sx) / sw) AS a FROM k),
kap AS (SELECT symbol, kappa, a, n_bins, 1 - sum((y - a * exp(-kappa * x)) * (y - a * exp(-kappa * x))) / sum((y - yb) * (y - yb)) AS r2
  FROM h JOIN k2 USING (symbol) GROUP BY symbol, kappa, a, n_bins)"""
add("A24_arrival_decay", lambda s, d: pf.arrival_decay(bars(s, d)), "symbol kappa:4 a:8 n_bins:l r2:4",
    f"{_KAP}\nSELECT * FROM kap")
_NLS = _KAP.replace("WITH ", "WITH RECURSIVE ", 1) + f""", st0 AS (SELECT symbol, a AS a0, kappa AS k0 FROM kap),
{fits.sql('h', 'st0', 'symbol')}"""
add("A24_arrival_fit", lambda s, d: pf.arrival_fit(bars(s, d)), "symbol kappa:4 a:8 sse:8 n_points:l",
    f"{_NLS}\nSELECT symbol, f.k AS kappa, f.a, f.sse, p.n_points FROM (SELECT symbol, len(pts) AS n_points FROM pts JOIN st0 USING (symbol)) p LEFT JOIN fitted f USING (symbol)")
_FS = f"""{BARS}, q AS (SELECT symbol, quantile_cont(bid_q1, 0.95) AS qb, quantile_cont(tick_count, 0.95) AS qt,
  quantile_cont(spread_mean, 0.95) AS qs FROM bars GROUP BY 1),
s AS (SELECT symbol, date, {hm(900)} AS hhmm, avg((1 / (bid_q1 / (qb + 1) + 1e-1)) * (1 / (tick_count / (qt + 1) + 1e-1))
  * (1 + spread_mean / (qs + 1e-2))) AS f FROM bars JOIN q USING (symbol) GROUP BY 1, 2, 3),
p AS (SELECT symbol, hhmm, avg(f) AS fill_score FROM s GROUP BY 1, 2),
n AS (SELECT *, (fill_score - min(fill_score) OVER (PARTITION BY symbol)) / (max(fill_score) OVER (PARTITION BY symbol)
  - min(fill_score) OVER (PARTITION BY symbol)) * 100 AS score FROM p),
fs AS (SELECT *, score >= quantile_cont(score, 0.75) OVER (PARTITION BY symbol) AS is_best FROM n)"""
add("A25_fill_score", lambda s, d: pf.fill_score(bars(s, d)), "symbol hhmm fill_score:6 score:5 is_best:b",
    f"{_FS}\nSELECT * FROM fs")
_RUN = f"""{BARS}, q AS (SELECT symbol, quantile_cont(tick_count, 0.25) AS p25, quantile_cont(tick_count, 0.75) AS p75 FROM bars GROUP BY 1),
b AS (SELECT symbol, ts_sec, tick_count, p25, p75, row_number() OVER {_LINE} AS pos, count(*) OVER (PARTITION BY symbol) AS nn,
  CASE WHEN tick_count > p75 THEN 'burst' WHEN tick_count < p25 THEN 'quiet' END AS kind FROM bars JOIN q USING (symbol)),
i AS (SELECT symbol, kind, pos - row_number() OVER (PARTITION BY symbol, kind ORDER BY ts_sec) AS run, pos, nn FROM b WHERE kind IS NOT NULL),
r AS (SELECT symbol, kind, run, count(*) AS len FROM i GROUP BY 1, 2, 3 HAVING NOT bool_or(pos = nn)),
runs AS (SELECT symbol, p25, p75, avg(CAST(tick_count > p75 AS INTEGER)) * 100 AS pct_burst, avg(CAST(tick_count < p25 AS INTEGER)) * 100 AS pct_quiet
  FROM b GROUP BY 1, 2, 3),
rl AS (SELECT symbol, quantile_cont(len, 0.5) FILTER (kind = 'burst') AS median_burst, quantile_cont(len, 0.5) FILTER (kind = 'quiet') AS median_quiet,
  quantile_cont(len, 0.75) FILTER (kind = 'burst') AS p75_burst, quantile_cont(len, 0.75) FILTER (kind = 'quiet') AS p75_quiet FROM r GROUP BY 1),
runall AS (SELECT * FROM runs LEFT JOIN rl USING (symbol))"""
add("A26_run_lengths", lambda s, d: pf.run_lengths(bars(s, d)),
    "symbol p25:6 p75:6 pct_burst:6 pct_quiet:6 median_burst:6 median_quiet:6 p75_burst:6 p75_quiet:6",
    f"{_RUN}\nSELECT * FROM runall")
add("O2_top_days",
    lambda s, d: bars(s, d).groupBy("symbol", "date").agg(F.sum("volume_delta").alias("vol"))
    .orderBy(F.desc("vol"), "symbol", "date").limit(20),
    "symbol date:d vol:l",
    f"{BARS}\nSELECT symbol, date, sum(volume_delta) AS vol FROM bars GROUP BY 1, 2 ORDER BY vol DESC, symbol, date LIMIT 20")


add("C25_volatility_report", lambda s, d: rp.volatility_report(stage(feats(s, d), "feats")),
    "symbol mean:5 std:5 p25:5 p75:5 cv:5 mean_low:5 mean_high:5 spread_mult:4 spread_low:4 spread_high:4",
    _DIST + ", " + _TERT[len(FEATS):].lstrip(", ").replace("v AS (SELECT symbol, realized_vol_60s AS v FROM feats WHERE realized_vol_60s > 0),\n", "", 1)
    + "\nSELECT * FROM dist JOIN tert USING (symbol)")

_SIGS = ["imbalance_last", "imbalance_ma_10s", "imbalance_ma_30s"]
_hit = " UNION ALL ".join(f"SELECT symbol, '{c}' AS signal, {c} AS x, fwd FROM hf" for c in _SIGS)
_HIT = f"""hf AS (SELECT *, lead(close, 3) OVER {_LINE} / close - 1 AS fwd FROM feats), hl AS ({_hit}),
hs AS (SELECT *, CASE WHEN x > 2e-1 THEN 1 WHEN x < -2e-1 THEN -1 ELSE 0 END AS side FROM hl),
hits AS (SELECT symbol, signal, avg(CAST(side * fwd > 0 AS INTEGER)) FILTER (side <> 0 AND fwd IS NOT NULL) * 100 AS hit_pct,
  corr(x, fwd) AS corr, count(*) FILTER (side <> 0 AND fwd IS NOT NULL) AS n_active, avg(CAST(side <> 0 AS INTEGER)) * 100 AS pct_active
  FROM hs GROUP BY 1, 2 HAVING count(*) FILTER (side <> 0 AND fwd IS NOT NULL) >= 50)"""


add("C26_liquidity_report", lambda s, d: rp.liquidity_report(stage(feats(s, d), "feats")),
    "symbol bid_median:6 tick:4 pct_1tick:6 tick_bps:5 pct_burst:6 median_burst:6 best_signal best_hit:6",
    f"{_TICK}, {_RUN[len(BARS):].lstrip(', ').replace('c AS', 'c AS')}, {FEATS[len(BARS):].lstrip(', ')}, {_HIT}, "
    "bh AS (SELECT symbol, arg_max(signal, (hit_pct, signal)) AS best_signal, max(hit_pct) AS best_hit FROM hits GROUP BY 1), "
    "qd AS (SELECT symbol, quantile_cont(bid_q1, 0.5) AS bid_median FROM bars GROUP BY 1)"
    "\nSELECT * FROM qd JOIN tick USING (symbol) JOIN runall USING (symbol) LEFT JOIN bh USING (symbol)")
add("C26_imbalance_hit_rate", lambda s, d: pf.imbalance_hits(feats(s, d), _SIGS),
    "symbol signal hit_pct:6 corr:5 n_active:l pct_active:6", f"{FEATS}, {_HIT}\nSELECT * FROM hits")


add("C27_arrival_report", lambda s, d: rp.arrival_report(stage(bars(s, d, 600), "bars"), 7200),
    "symbol n_bars:l mean_gap:4 ks_stat:6 kappa:4 r2:4 spread_median:6 spread_p75:6 bps_median:4 min_spread_safe:b",
    _GAP.replace(" c AS", " c9 AS") + ", " + _KAP[len(BARS):].lstrip(", ").replace("s AS (SELECT symbol, count(*) AS n_bins", "sk AS (SELECT symbol, count(*) AS n_bins")
    .replace("FROM s)", "FROM sk)").replace("e AS (SELECT symbol, min(d)", "ek AS (SELECT symbol, min(d)").replace("JOIN e USING", "JOIN ek USING")
    + """, ss AS (SELECT symbol, quantile_cont(spread_mean, 0.5) AS spread_median, quantile_cont(spread_mean, 0.75) AS spread_p75,
  quantile_cont(spread_mean / close * 10000, 0.5) AS bps_median FROM bars WHERE spread_mean > 0 GROUP BY 1)
SELECT *, spread_median >= 1e-1 AS min_spread_safe FROM arr LEFT JOIN kap USING (symbol) LEFT JOIN ss USING (symbol)""")
