"""Information coefficients, regimes and price impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.flow import IMB_SQL
from tickloom.catalog.standin import BARS, FEATS, FEATS_DAY, TICKS, bars, bars_cte, feats
from tickloom.operators import fits, ic, kyle, regime
from tickloom.operators.features import forward_returns
from tickloom.plans import reports as rp
from tickloom.plans import rollup as ru
from tickloom.session import scratch_path, stage
from tickloom.sources.storage import write_partitioned

_LINE = "(PARTITION BY symbol ORDER BY ts_sec)"
_SIGS = ["imb_simple", "imb_delta", "ofi_norm", "imb_combined"]
_HS = [1, 5, 10]


def _measured(s, d):
    return rp.measured_signals(feats(s, d), _HS)


_fw = ", ".join(f"ln(lead(mid, {h}) OVER {_LINE} / mid) AS fwd_{h}" for h in _HS)
_FW = f"""{IMB_SQL}, fm AS (SELECT *, coalesce(weighted_mid, close) AS mid FROM im),
fwd AS (SELECT *, {_fw}, CASE WHEN ist_tod < 35100 THEN 'open' WHEN ist_tod >= 53100 THEN 'close' ELSE 'midday' END AS session FROM fm)"""
_pairs = " UNION ALL ".join(
    f"SELECT symbol, session, vol_regime, '{s}' AS signal, round({s}, 9) AS x, {h} AS horizon, fwd_{h} AS y FROM reg"
    for s in _SIGS for h in _HS)
_REG = f"""{_FW}, vq AS (SELECT symbol, quantile_cont(coalesce(realized_vol_60s, 0), 0.5) AS q50,
  quantile_cont(coalesce(realized_vol_60s, 0), 0.75) AS q75 FROM fwd GROUP BY 1),
reg AS (SELECT fwd.*, CASE WHEN coalesce(realized_vol_60s, 0) <= q50 THEN 'low_vol' WHEN coalesce(realized_vol_60s, 0) <= q75
  THEN 'mid_vol' ELSE 'high_vol' END AS vol_regime FROM fwd JOIN vq USING (symbol)),
pairs AS (SELECT * FROM ({_pairs}) WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _ic_sql(keys, min_obs, where="TRUE"):
    k = ", ".join(keys)
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2 AS ry FROM pairs WHERE {where}),
ict AS (SELECT {k}, corr(rx, ry) AS ic, avg(CAST(sign(x) = sign(y) AS INTEGER)) AS hit_rate,
  avg(sign(x) * y) / stddev(sign(x) * y) * sqrt(252 * 23400) AS sharpe, count(*) AS n_obs FROM rk GROUP BY {k} HAVING count(*) >= {min_obs}),
icx AS (SELECT *, ic * sqrt((n_obs - 2) / (1 - ic * ic)) AS t_stat FROM ict)"""


def _pairs_df(s, d, keep=("symbol",), vol=False):
    m = _measured(s, d)
    if vol:
        m = ic.with_vol_regime(m)
    hs = _HS if keep == ("symbol",) else [5]
    return stage(ic.signal_pairs(m.withColumns({c: F.round(c, 9) for c in _SIGS}), list(keep), _SIGS, hs), "ic-pairs")


def _table(s, d):
    return ic.ic_table(_pairs_df(s, d), ["symbol", "signal", "horizon"])


_IC = f"{_REG}, {_ic_sql(['symbol', 'signal', 'horizon'], 100)}"
add("A15_information_coefficient", _table, "symbol signal horizon:l ic:5 hit_rate:6 sharpe:3 t_stat:4 n_obs:l",
    f"{_IC}\nSELECT * FROM icx")
add("A16_ic_stability",
    lambda s, d: ic.ic_stability(_measured(s, d).withColumns({c: F.round(c, 9) for c in _SIGS}), _SIGS, 5),
    "symbol signal ic:5 hit_rate:6 ic_mean:5 ic_t:3 n_blocks:l useful:b strong:b",
    f"""{_REG}, v AS (SELECT *, row_number() OVER {_LINE} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS nn FROM fwd WHERE fwd_5 IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT symbol, '{c}' AS signal, coalesce(round({c}, 9), 0) AS x, fwd_5 AS y, pos // 300 AS blk, nn FROM v" for c in _SIGS)}),
w AS (SELECT *, rank() OVER (PARTITION BY symbol, signal ORDER BY x) + (count(*) OVER (PARTITION BY symbol, signal, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY symbol, signal ORDER BY y) + (count(*) OVER (PARTITION BY symbol, signal, y) - 1) / 2 AS ry,
  rank() OVER (PARTITION BY symbol, signal, blk ORDER BY x) + (count(*) OVER (PARTITION BY symbol, signal, blk, x) - 1) / 2 AS bx,
  rank() OVER (PARTITION BY symbol, signal, blk ORDER BY y) + (count(*) OVER (PARTITION BY symbol, signal, blk, y) - 1) / 2 AS by_ FROM l),
b AS (SELECT symbol, signal, blk, corr(bx, by_) AS ic FROM w WHERE (blk + 1) * 300 < nn GROUP BY 1, 2, 3
  HAVING stddev_pop(x) > 1e-10 AND stddev_pop(y) > 1e-10),
bb AS (SELECT symbol, signal, avg(ic) AS m, stddev_pop(ic) AS sd, count(*) AS k FROM b GROUP BY 1, 2),
a AS (SELECT symbol, signal, corr(rx, ry) AS ic, avg(CAST(sign(x) = sign(y) AS INTEGER)) AS hit_rate FROM w GROUP BY 1, 2)
SELECT symbol, signal, ic, hit_rate, coalesce(m, ic) AS ic_mean, coalesce(m, ic) / greatest(coalesce(sd, 1e-2), 1e-3) AS ic_t,
  coalesce(k, 0) AS n_blocks, abs(ic) > 2e-2 OR hit_rate > 52e-2 AS useful, abs(ic) > 5e-2 OR hit_rate > 55e-2 AS strong
FROM a LEFT JOIN bb USING (symbol, signal)""")
add("A17_ic_by_session",
    lambda s, d: ic.ic_table(_pairs_df(s, d, ("symbol", "session")).where("horizon = 5"), ["symbol", "session", "signal"], 50),
    "symbol session signal ic:5 n_obs:l",
    f"{_REG}, {_ic_sql(['symbol', 'session', 'signal'], 50, 'horizon = 5')}\nSELECT * FROM icx")
add("A17_ic_by_vol_regime",
    lambda s, d: ic.ic_table(_pairs_df(s, d, ("symbol", "vol_regime"), True).where("horizon = 5"), ["symbol", "vol_regime", "signal"], 50),
    "symbol vol_regime signal ic:5 n_obs:l",
    f"{_REG}, {_ic_sql(['symbol', 'vol_regime', 'signal'], 50, 'horizon = 5')}\nSELECT * FROM icx")
add("A18_signal_ranking", lambda s, d: ic.rank_signals(_table(s, d)),
    "signal horizon:l avg_ic:5 std_ic:5 avg_hit:6 avg_sharpe:3 n_symbols:l n_useful:l n_strong:l",
    f"""{_IC}
SELECT signal, horizon, avg(ic) AS avg_ic, stddev(ic) AS std_ic, avg(hit_rate) AS avg_hit, avg(sharpe) AS avg_sharpe,
  count(DISTINCT symbol) AS n_symbols, count(*) FILTER (abs(ic) > 2e-2 OR hit_rate > 52e-2) AS n_useful,
  count(*) FILTER (abs(ic) > 5e-2 OR hit_rate > 55e-2) AS n_strong FROM icx GROUP BY 1, 2""")
add("C28_ic_report", lambda s, d: rp.ic_report(_pairs_df(s, d)), "symbol signal decay_rate:4 peak_ic:5",
    f"""{_IC}, z AS (SELECT symbol, signal, count(*) AS n, sum(ic*ic) AS sw, sum(ic*ic*horizon) AS sx, sum(ic*ic*ln(abs(ic))) AS sy,
  sum(ic*ic*horizon*horizon) AS sxx, sum(ic*ic*horizon*ln(abs(ic))) AS sxy, max(ic) AS peak_ic FROM icx WHERE ic <> 0 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT *, -(sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS decay_rate FROM z""")

_ICF = _IC.replace("WITH ", "WITH RECURSIVE ", 1) if not _IC.startswith("WITH RECURSIVE") else _IC
_ICN = f"""{_ICF}, z AS (SELECT symbol, signal, count(*) AS n, sum(ic*ic) AS sw, sum(ic*ic*horizon) AS sx, sum(ic*ic*ln(abs(ic))) AS sy,
  sum(ic*ic*horizon*horizon) AS sxx, sum(ic*ic*horizon*ln(abs(ic))) AS sxy, max(ic) AS peak_ic FROM icx WHERE ic <> 0 GROUP BY 1, 2 HAVING count(*) >= 3),
sz AS (SELECT symbol, signal, horizon AS x, abs(ic) AS y FROM icx WHERE ic <> 0),
st0 AS (SELECT symbol, signal, abs(peak_ic) AS a0, -(sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS k0 FROM z),
{fits.sql('sz', 'st0', 'symbol, signal')}"""
add("C28_ic_decay_fit", lambda s, d: ic.ic_decay_fit(_table(s, d)), "symbol signal decay_rate:4 a:5 n_points:l",
    f"""{_ICN}
SELECT symbol, signal, f.k AS decay_rate, f.a, p.n_points FROM (SELECT symbol, signal, len(pts) AS n_points FROM pts JOIN st0 USING (symbol, signal)) p LEFT JOIN fitted f USING (symbol, signal)""")

# ---- regimes -------------------------------------------------------------------

_R1 = f"{BARS}, r AS (SELECT symbol, date, ts_sec, close, close / lag(close) OVER {_LINE} - 1 AS ret FROM bars)"
_LAGS = (1, 5, 10, 30, 60)
add("W28_return_autocorr", lambda s, d: regime.return_autocorr(bars(s, d), _LAGS),
    "symbol " + " ".join(f"acf_{k}:5" for k in _LAGS) + " character",
    f"""{_R1}, q AS (SELECT symbol, quantile_cont(abs(ret), 0.99) AS c FROM r WHERE ret IS NOT NULL GROUP BY 1),
t AS (SELECT symbol, ts_sec, ret FROM r JOIN q USING (symbol) WHERE abs(ret) < c),
l AS (SELECT symbol, ret, {', '.join(f'lag(ret, {k}) OVER {_LINE} AS l{k}' for k in _LAGS)} FROM t),
a AS (SELECT symbol, {', '.join(f'corr(ret, l{k}) AS acf_{k}' for k in _LAGS)} FROM l GROUP BY 1)
SELECT *, CASE WHEN acf_1 < -5e-2 THEN 'MEAN_REVERTING' WHEN acf_1 > 5e-2 THEN 'TRENDING' ELSE 'CHOPPY' END AS character FROM a""")
add("W28_daily_autocorr", lambda s, d: regime.daily_autocorr(bars(s, d), 20), "symbol date:d acf_1:5 n:l",
    f"""{BARS}, r AS (SELECT symbol, date, ts_sec, close / lag(close) OVER (PARTITION BY symbol, date ORDER BY ts_sec) - 1 AS ret FROM bars),
l AS (SELECT *, lag(ret) OVER (PARTITION BY symbol, date ORDER BY ts_sec) AS l1 FROM r)
SELECT symbol, date, corr(ret, l1) AS acf_1, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) >= 20""")
_VA = f"""{FEATS}, v AS (SELECT symbol, realized_vol_60s AS v, row_number() OVER {_LINE} AS pos FROM feats WHERE realized_vol_60s > 0),
k AS (SELECT unnest(range(1, 41)) AS lag), acf AS (SELECT a.symbol, lag, corr(a.v, b.v) AS acf FROM v a JOIN k ON TRUE JOIN v b
  ON a.symbol = b.symbol AND b.pos = a.pos - lag GROUP BY 1, 2)"""
add("W27_vol_autocorr", lambda s, d: regime.vol_autocorr(feats(s, d), max_lag=40), "symbol lag:l acf:6", f"{_VA}\nSELECT * FROM acf")
add("W27_vol_half_life", lambda s, d: regime.vol_half_life(regime.vol_autocorr(feats(s, d), max_lag=40), 40),
    "symbol half_life:l acf_lag1:6",
    f"{_VA}\nSELECT symbol, coalesce(min(lag) FILTER (acf < 5e-1), 40) AS half_life, max(acf) FILTER (lag = 1) AS acf_lag1 FROM acf GROUP BY 1")
_QS = (5, 10, 30, 60)
_VR = f"""{BARS}, rq AS (SELECT symbol, {', '.join(f'close / lag(close, {q}) OVER {_LINE} - 1 AS r{q}' for q in (1, *_QS))} FROM bars),
c AS (SELECT symbol, {', '.join(f'quantile_cont(abs(r{q}), 0.99) AS c{q}' for q in (1, *_QS))} FROM rq GROUP BY 1),
vv AS (SELECT symbol, {', '.join(f'var_samp(r{q}) FILTER (abs(r{q}) < c{q}) AS v{q}' for q in (1, *_QS))} FROM rq JOIN c USING (symbol) GROUP BY 1),
vr AS (SELECT symbol, {', '.join(f'v{q} / ({q} * v1) AS vr_{q}' for q in _QS)} FROM vv)"""
add("W29_variance_ratio", lambda s, d: regime.variance_ratio(bars(s, d), _QS), "symbol " + " ".join(f"vr_{q}:6" for q in _QS) + " character",
    f"{_VR}\nSELECT *, CASE WHEN vr_10 < 95e-2 THEN 'MEAN_REVERTING' WHEN vr_10 > 105e-2 THEN 'TRENDING' ELSE 'CHOPPY' END AS character FROM vr")
_HU = f"""{_R1}, x AS (SELECT symbol, ret, row_number() OVER {_LINE} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL),
lg AS (SELECT unnest(range(2, 100)) AS lag),
w AS (SELECT symbol, lag, pos // lag AS b, pos, ret FROM x JOIN lg ON n >= 200 AND (pos // lag + 1) * lag <= n),
m AS (SELECT symbol, lag, b, pos, ret - avg(ret) OVER (PARTITION BY symbol, lag, b) AS dv, stddev_pop(ret) OVER (PARTITION BY symbol, lag, b) AS sd FROM w),
cs AS (SELECT symbol, lag, b, sd, sum(dv) OVER (PARTITION BY symbol, lag, b ORDER BY pos) AS c FROM m),
rr AS (SELECT symbol, lag, b, (max(c) - min(c)) / any_value(sd) AS rs FROM cs WHERE sd > 0 GROUP BY 1, 2, 3),
rs AS (SELECT symbol, lag, avg(rs) AS rs FROM rr GROUP BY 1, 2),
hu AS (SELECT symbol, regr_slope(ln(rs), ln(lag)) AS hurst, count(*) AS n_lags FROM rs GROUP BY 1 HAVING count(*) >= 5)"""
add("W30_hurst", lambda s, d: regime.hurst(bars(s, d)), "symbol hurst:6 n_lags:l character",
    f"{_HU}\nSELECT *, CASE WHEN hurst < 45e-2 THEN 'MEAN_REVERTING' WHEN hurst > 55e-2 THEN 'TRENDING' ELSE 'CHOPPY' END AS character FROM hu")


def _labels(s, d):
    return regime.regime_labels(stage(feats(s, d), "feats"))


_LAB = f"""{FEATS}, p AS (SELECT symbol, quantile_cont(realized_vol_60s, 0.75) AS p75 FROM feats GROUP BY 1),
z AS (SELECT *, close / lag(close) OVER {_LINE} - 1 AS r1, close / lag(close, 10) OVER {_LINE} - 1 AS rq, row_number() OVER {_LINE} - 1 AS i FROM feats),
z2 AS (SELECT *, avg(realized_vol_60s) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING) AS vb,
  var_samp(rq) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 290 PRECEDING AND 1 PRECEDING) /
  (10 * var_samp(r1) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 299 PRECEDING AND 1 PRECEDING)) AS vr FROM z),
lab AS (SELECT z2.*, CASE WHEN i < 300 THEN 'CHOPPY' WHEN vb > p75 * 15e-1 THEN 'VOLATILE' WHEN vr < 85e-2 THEN 'MEAN_REVERTING'
  WHEN vr > 115e-2 THEN 'TRENDING' ELSE 'CHOPPY' END AS regime FROM z2 JOIN p USING (symbol))"""


def _share_sql(keys):
    return f"SELECT {keys}, " + ", ".join(
        f"avg(CAST(regime = '{r}' AS INTEGER)) * 100 AS pct_{r.lower()}" for r in regime.LABELS) + f" FROM lab GROUP BY {keys}"


_PCT = " ".join(f"pct_{r.lower()}:5" for r in regime.LABELS)
add("W22_regime_labels", _labels, "symbol ts_sec regime", f"{_LAB}\nSELECT * FROM lab")
add("A20_regime_shares", lambda s, d: regime.regime_shares(_labels(s, d), ["symbol", "date"]), f"symbol date:d {_PCT}",
    f"{_LAB}\n{_share_sql('symbol, date')}")


def _results(s, d):
    return bars(s, d).groupBy("symbol", "date").agg(
        (F.max_by("close", "ts_sec") - F.min_by("open", "ts_sec")).alias("pnl"))


add("A21_regime_outcome", lambda s, d: regime.regime_outcome(regime.regime_shares(_labels(s, d), ["symbol", "date"]), _results(s, d)),
    "regime corr:5 mean_profitable:5 mean_losing:5 n:l",
    f"""{_LAB}, sh AS ({_share_sql('symbol, date')}), pn AS (SELECT symbol, date, arg_max(close, ts_sec) - arg_min(open, ts_sec) AS pnl FROM bars GROUP BY 1, 2),
u AS ({' UNION ALL '.join(f"SELECT pnl, 'pct_{r.lower()}' AS regime, pct_{r.lower()} AS pct FROM sh JOIN pn USING (symbol, date)" for r in regime.LABELS)})
SELECT regime, corr(pct, pnl) AS corr, avg(pct) FILTER (pnl > 0) AS mean_profitable, avg(pct) FILTER (NOT pnl > 0) AS mean_losing, count(*) AS n
FROM u GROUP BY 1""")
_MOM = f"""mt AS (SELECT symbol, quantile_cont(abs(price_mom_60s), 0.99) AS c FROM lab GROUP BY 1),
th AS (SELECT symbol, quantile_cont(abs(price_mom_60s), 0.75) AS threshold FROM lab JOIN mt USING (symbol) WHERE abs(price_mom_60s) < c GROUP BY 1),
mf AS (SELECT symbol, price_mom_60s AS m, regime, lead(close, 60) OVER {_LINE} / close - 1 AS fwd FROM lab),
mom AS (SELECT symbol, threshold, avg(CAST(regime = 'TRENDING' AS INTEGER)) FILTER (abs(m) > threshold) * 100 AS pct_trending, corr(m, fwd) AS fwd_corr
  FROM mf JOIN th USING (symbol) GROUP BY 1, 2)"""
add("A22_momentum_threshold", lambda s, d: regime.momentum_threshold(_labels(s, d)),
    "symbol threshold:6 pct_trending:6 fwd_corr:6 pause_signal:b",
    f"{_LAB}, {_MOM}\nSELECT *, pct_trending > 30 OR abs(fwd_corr) > 5e-2 AS pause_signal FROM mom")


def _regime_report(s, d):
    return rp.regime_report(stage(bars(s, d), "bars"), stage(_labels(s, d), "labels"), _QS)


add("C24_regime_report", _regime_report, f"symbol {_PCT} vr_5:6 vr_10:6 hurst:6",
    f"{_LAB}, sh AS ({_share_sql('symbol')}), {_VR[len(BARS):].lstrip(', ')}, {_HU[len(BARS):].lstrip(', ')}"
    "\nSELECT * FROM sh JOIN vr USING (symbol) LEFT JOIN hu USING (symbol)")
_EST = f"""{FEATS}, e0 AS (SELECT *, row_number() OVER {_LINE} AS pos, lead(realized_vol_60s, 60) OVER {_LINE} AS target,
  close / lag(close) OVER {_LINE} - 1 AS ret, CASE WHEN count(realized_vol_60s) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) >= 30
  THEN avg(realized_vol_60s) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) END AS est_roll FROM feats),
wk AS (SELECT a.symbol, a.pos, sum(pow(59e0 / 61, a.pos - b.pos)) AS w, sum(pow(59e0 / 61, 2 * (a.pos - b.pos))) AS w2,
  sum(pow(59e0 / 61, a.pos - b.pos) * b.ret) AS m, count(*) AS n FROM e0 a JOIN e0 b ON a.symbol = b.symbol AND b.pos <= a.pos AND b.pos > a.pos - 800 AND b.ret IS NOT NULL GROUP BY 1, 2),
wv AS (SELECT a.symbol, a.pos, any_value(w) AS w, any_value(w2) AS w2, any_value(n) AS n,
  sum(pow(59e0 / 61, a.pos - b.pos) * (b.ret - m / w) * (b.ret - m / w)) AS s2 FROM wk a JOIN e0 b ON a.symbol = b.symbol AND b.pos <= a.pos AND b.pos > a.pos - 800 AND b.ret IS NOT NULL GROUP BY 1, 2),
ew AS (SELECT symbol, pos, CASE WHEN n > 1 THEN sqrt(s2 / w * (w * w / (w * w - w2))) END AS est_ewm FROM wv),
l AS ({' UNION ALL '.join(f"SELECT symbol, target, 'est_{k}' AS estimator, {c} AS x FROM e0 LEFT JOIN ew USING (symbol, pos)" for k, c in [('60s', 'realized_vol_60s'), ('300s', 'realized_vol_300s'), ('ewm', 'est_ewm'), ('roll', 'est_roll')])}),
est AS (SELECT symbol, estimator, avg(abs(target - x)) AS mae, corr(target, x) AS corr, count(*) AS n FROM l WHERE x > 0 AND target > 0 GROUP BY 1, 2 HAVING count(*) >= 50)"""
add("W26_sigma_estimators", lambda s, d: regime.sigma_estimators(feats(s, d)), "symbol estimator mae:5 corr:5 n:l is_best:b",
    f"{_EST}\nSELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mae) = 1 AS is_best FROM est")

# ---- price impact ----------------------------------------------------------------

_DAY = "(PARTITION BY symbol, date ORDER BY ts_sec"
_KY = f"""{BARS}, k0 AS (SELECT *, close - lag(close) OVER {_DAY}) AS dp0, row_number() OVER {_DAY}) AS i FROM bars),
k1 AS (SELECT *, CASE WHEN dp0 IS NOT NULL AND volume_delta <> 0 THEN volume_delta::DOUBLE END AS sv,
  CASE WHEN dp0 IS NOT NULL AND volume_delta <> 0 THEN dp0 END AS dp FROM k0),
k2 AS (SELECT symbol, date, ts_sec, i, count(sv) OVER w AS n, sum(dp * sv) OVER w AS xy, sum(sv * sv) OVER w AS xx, sum(dp * dp) OVER w AS yy,
  var_pop(dp) OVER w AS vp, avg(spread_bps) OVER {_DAY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS asb FROM k1
  WINDOW w AS {_DAY} ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
pr AS (SELECT a.symbol, a.date, a.ts_sec, median((c.dp - b.dp) / (c.sv - b.sv)) AS med FROM k1 a
  JOIN k1 b ON a.symbol = b.symbol AND a.date = b.date AND b.i BETWEEN a.i - 28 AND a.i AND b.sv IS NOT NULL
  JOIN k1 c ON a.symbol = c.symbol AND a.date = c.date AND c.i > b.i AND c.i <= a.i AND c.sv IS NOT NULL
  WHERE abs(c.sv - b.sv) > 1e-10 GROUP BY 1, 2, 3),
lam AS (SELECT k2.symbol, k2.date, k2.ts_sec, least(i, 30) AS window_bars, n >= 5 AS estimated, asb,
  CASE WHEN n >= 5 THEN xy / xx ELSE 0 END AS lambda_ols,
  CASE WHEN n >= 5 AND vp * n > 1e-12 THEN greatest(0, 1 - (yy - 2 * xy / xx * xy + xy / xx * xy / xx * xx) / (vp * n)) ELSE 0 END AS r_squared,
  CASE WHEN n >= 5 THEN coalesce(med, 0) ELSE 0 END AS lambda_robust FROM k2 LEFT JOIN pr USING (symbol, date, ts_sec) WHERE i >= 10),
cal AS (SELECT symbol, date, quantile_cont(round(lambda_robust, 6), 0.25) AS p25, quantile_cont(round(lambda_robust, 6), 0.75) AS p75 FROM lam
  WHERE round(lambda_robust, 6) > 0 GROUP BY 1, 2 HAVING count(*) >= 10),
tox0 AS (SELECT lam.*, CASE WHEN estimated AND asb > 0 AND lambda_robust > 0 THEN least(greatest(CASE WHEN p75 > p25 THEN (lambda_robust - p25) / (p75 - p25)
  ELSE least(lambda_robust / 5e-3, 1) END, 0), 1) ELSE 0 END AS toxicity FROM lam LEFT JOIN cal USING (symbol, date)),
tox AS (SELECT *, CASE WHEN estimated THEN 5e-1 + toxicity * 25e-1 ELSE 1 END AS multiplier,
  CASE WHEN toxicity < 25e-2 THEN 'LOW' WHEN toxicity < 5e-1 THEN 'MEDIUM' WHEN toxicity < 75e-2 THEN 'HIGH' ELSE 'EXTREME' END AS regime FROM tox0)"""
add("W19_kyle_lambda", lambda s, d: kyle.impact(bars(s, d)), "symbol ts_sec window_bars:l lambda_ols:6 r_squared:5 estimated:b",
    f"{_KY}\nSELECT * FROM lam")
add("W20_theil_sen", lambda s, d: kyle.impact(bars(s, d)), "symbol ts_sec lambda_robust:9", f"{_KY}\nSELECT * FROM lam")
_KYL = _KY.replace(BARS, f"WITH {TICKS}, {bars_cte(60)}", 1)
for _a, _b in (("29 PRECEDING", "99 PRECEDING"), ("28 PRECEDING", "98 PRECEDING"), ("a.i - 28", "a.i - 98"), ("least(i, 30)", "least(i, 100)")):
    _KYL = _KYL.replace(_a, _b)
add("W20_theil_sen_long", lambda s, d: kyle.impact(bars(s, d, 60), window=100), "symbol ts_sec lambda_robust:8 window_bars:l", f"{_KYL}\nSELECT * FROM lam")
add("W21_toxicity", lambda s, d: kyle.toxicity(kyle.impact(bars(s, d))), "symbol ts_sec toxicity:5 multiplier:5 regime",
    f"{_KY}\nSELECT * FROM tox")
_adv = "CASE dominant_regime " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kyle.ADVICE.items()) + " END"
add("C23_kyle_report", lambda s, d: rp.kyle_report(bars(s, d))[1],
    "symbol date:d bars_analysed:l lambda_mean:5 lambda_median:5 lambda_p75:5 lambda_p95:5 avg_toxicity:5 max_toxicity:5 avg_multiplier:5 "
    "n_low:l n_medium:l n_high:l n_extreme:l dominant_regime recommendation",
    f"""{_KY}, g AS (SELECT symbol, date, count(*) AS bars_analysed, avg(lambda_robust) AS lambda_mean, quantile_cont(lambda_robust, 0.5) AS lambda_median,
  quantile_cont(lambda_robust, 0.75) AS lambda_p75, quantile_cont(lambda_robust, 0.95) AS lambda_p95, avg(toxicity) AS avg_toxicity,
  max(toxicity) AS max_toxicity, avg(multiplier) AS avg_multiplier, {', '.join(f"count(*) FILTER (regime = '{r}') AS n_{r.lower()}" for r in kyle.REGIMES)}
  FROM tox GROUP BY 1, 2),
dm AS (SELECT *, CASE greatest(n_low, n_medium, n_high, n_extreme) WHEN n_low THEN 'LOW' WHEN n_medium THEN 'MEDIUM' WHEN n_high THEN 'HIGH' ELSE 'EXTREME' END AS dominant_regime FROM g)
SELECT *, {_adv} AS recommendation FROM dm""")

# ---- nightly state ---------------------------------------------------------------

_METRICS = ["close", "spread_mean", "realized_vol_60s"]
_DAYSIGS = ["imbalance_last", "spread_zscore", "volume_ratio"]


def _nights(s, d):
    """State of all days but the last two, then of the last two in a night of their own."""
    stored, path = scratch_path(s, "nightly-bars"), scratch_path(s, "nightly-state")
    write_partitioned(feats(s, d, cross_day=False), stored, ["date"], ["symbol", "ts_sec"])
    f = s.read.parquet(stored).withColumn("date", F.col("date").cast("date"))
    measured = lambda b: forward_returns(b, _HS, "log", "mid").withColumns({c: F.round(c, 9) for c in _DAYSIGS})
    last = sorted(r.date for r in f.select("date").distinct().collect())[-2:]
    for bars_ in (f.where(~F.col("date").isin(last)), f):
        ru.update(s, bars_, path, _METRICS, measured, _DAYSIGS, _HS)
    return path


add("C25_merged_moments", lambda s, d: ru.merged_moments(ru.state(s, _nights(s, d), "moments", "2024-01-04"), ["symbol", "metric"]),
    "symbol metric n:l mean:6 std:6 low:6 high:6",
    f"""{FEATS_DAY}, u AS ({' UNION ALL '.join(f"SELECT symbol, '{m}' AS metric, {m} AS x FROM feats WHERE date >= DATE '2024-01-04'" for m in _METRICS)})
SELECT symbol, metric, count(*) AS n, avg(x) AS mean, stddev(x) AS std, min(x) AS low, max(x) AS high FROM u WHERE isfinite(x) GROUP BY 1, 2""")
add("C28_merged_ic", lambda s, d: ru.merged_ic(ru.state(s, _nights(s, d), "ic")), "symbol signal horizon:l ic_mean:5 ic_std:5 n_days:l hit_rate:6 n_obs:l t_stat:3",
    f"""{FEATS_DAY}, fd AS (SELECT *, {', '.join(f"ln(lead(coalesce(weighted_mid, close), {h}) OVER (PARTITION BY symbol, date ORDER BY ts_sec) / coalesce(weighted_mid, close)) AS fwd_{h}" for h in _HS)} FROM feats),
pairs AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT symbol, date, '{c}' AS signal, round({c}, 9) AS x, {h} AS horizon, fwd_{h} AS y FROM fd" for c in _DAYSIGS for h in _HS)}) WHERE isfinite(x) AND isfinite(y)),
{_ic_sql(['symbol', 'date', 'signal', 'horizon'], 20)},
md AS (SELECT symbol, signal, horizon, avg(ic) AS ic_mean, stddev(ic) AS ic_std, count(ic) AS n_days, sum(hit_rate * n_obs) / sum(n_obs) AS hit_rate, sum(n_obs) AS n_obs FROM icx GROUP BY 1, 2, 3)
SELECT *, CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std * sqrt(n_days) END AS t_stat FROM md""")
