"""Pair research."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import BARS, bars
from tickloom.operators import pairs as pr
from tickloom.session import stage

_SEC = "CASE WHEN symbol IN ('click', 'view', 'signup') THEN 'web' ELSE 'shop' END"


def _prices(s, d):
    return bars(s, d).selectExpr("symbol", "date", "ts_sec", "coalesce(weighted_mid, close) AS price", f"{_SEC} AS sector")


def _aligned(s, d):
    p = stage(_prices(s, d), "prices")
    pairs = pr.sector_pairs(p.select("symbol", "sector").distinct())
    return stage(pr.aligned(p.drop("sector"), pairs, 100), "aligned")


_AL = f"""{BARS}, pc AS (SELECT symbol, date, ts_sec, coalesce(weighted_mid, close) AS price, {_SEC} AS sector FROM bars),
al0 AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.sector, a.symbol AS sym1, b.symbol AS sym2, a.date, a.ts_sec, a.price AS y, b.price AS x
  FROM pc a JOIN pc b ON a.sector = b.sector AND a.ts_sec = b.ts_sec AND a.symbol < b.symbol),
al AS (SELECT * FROM al0 QUALIFY count(*) OVER (PARTITION BY symbol) >= 100),
hg AS (SELECT symbol, sector, sym1, sym2, regr_slope(y, x) AS hedge_ratio, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared, corr(y, x) AS correlation,
  avg(y) AS my, avg(x) AS mx, count(*) AS n_bars, count(DISTINCT date) AS n_dates FROM al GROUP BY 1, 2, 3, 4),
sp AS (SELECT al.*, y - hedge_ratio * x AS s FROM al JOIN hg USING (symbol)),
lv AS (SELECT symbol, avg(s) AS spread_mean, stddev_pop(s) AS spread_std FROM sp GROUP BY 1)"""
add("J4_pair_alignment", _aligned, "symbol ts_sec:l y:6 x:6", f"{_AL}\nSELECT * FROM al")
add("J5_sector_pairs",
    lambda s, d: pr.sector_pairs(_prices(s, d).select("symbol", "sector").distinct()), "sector sym1 sym2",
    f"{_AL}, m AS (SELECT DISTINCT symbol, sector FROM pc)\nSELECT a.sector, a.symbol AS sym1, b.symbol AS sym2 FROM m a JOIN m b ON a.sector = b.sector AND a.symbol < b.symbol")
add("U5_common_seconds", lambda s, d: pr.common_seconds(_prices(s, d), "click", "view"), "ts_sec:l",
    f"{_AL}\nSELECT ts_sec FROM (SELECT ts_sec FROM pc WHERE symbol = 'click' INTERSECT SELECT ts_sec FROM pc WHERE symbol = 'view')")


def _stats(s, d):
    return pr.screen(_aligned(s, d))


def _cdf(x):
    def poly(cs):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * least(abs({x}), 707e-2) + {c!r}::DOUBLE)"
        return out
    t = f"exp(-least(abs({x}), 707e-2) * least(abs({x}), 707e-2) / 2) * {poly(pr.NUM)} / {poly(pr.DEN)}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {t} ELSE {t} END)"


_ps = f"({pr.P_SMALL[0]} + {pr.P_SMALL[1]} * t + {pr.P_SMALL[2]} * t * t)"
_plg = f"({pr.P_LARGE[0]} + {pr.P_LARGE[1]} * t + ({pr.P_LARGE[2]}) * t * t + ({pr.P_LARGE[3]}) * t * t * t)"
_SCR = f"""{_AL}, lg AS (SELECT sp.*, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2, (s - spread_mean) / greatest(spread_std, 1e-8) AS z FROM sp JOIN lv USING (symbol)
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_sec)),
dl AS (SELECT *, s - s1 AS w, s1 - s2 AS v, lag(z) OVER (PARTITION BY symbol ORDER BY ts_sec) AS z1 FROM lg),
mo AS (SELECT symbol, count(v) AS k, var_samp(s1) FILTER (v IS NOT NULL) AS uu, var_samp(v) AS vv, var_samp(w) FILTER (v IS NOT NULL) AS ww,
  covar_samp(s1, v) AS uv, covar_samp(s1, w) FILTER (v IS NOT NULL) AS uw, covar_samp(v, w) AS vw, covar_samp(s1, w) / var_pop(s1) AS phi, count(w) AS kw,
  sum(CASE WHEN z1 IS NULL THEN 0 ELSE CAST(sign(z - 2) <> sign(z1 - 2) AS INTEGER) + CAST(sign(z + 2) <> sign(z1 + 2) AS INTEGER) END) AS crossings FROM dl GROUP BY 1),
gm AS (SELECT *, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS g, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS d FROM mo),
ad AS (SELECT *, g / sqrt((ww - g * uw - d * vw) / (k - 3) * vv / (uu * vv - uv * uv)) AS t FROM gm),
scr AS (SELECT hg.*, spread_mean, spread_std, t AS adf_stat, crossings / n_dates AS daily_signals, spread_std / ((my + mx) / 2) * 10000 AS spread_std_bps,
  CASE WHEN phi > -1 AND phi < 0 AND kw > 100 THEN -ln(2) / ln(1 + phi) END AS half_life,
  CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 WHEN t <= -1.61 THEN {_cdf(_ps)} ELSE {_cdf(_plg)} END AS pvalue FROM hg JOIN lv USING (symbol) JOIN ad USING (symbol))"""
add("C15_pair_screening", lambda s, d: pr.tradable(_stats(s, d), 0.1, 1800, 3.0, 1),
    "symbol sector hedge_ratio:6 intercept:5 r_squared:6 correlation:6 n_bars:l n_dates:l adf_stat:4 pvalue:8 half_life:5 spread_mean:5 "
    "spread_std:5 spread_std_bps:3 daily_signals:6 verdict",
    f"""{_SCR}
SELECT *, CASE WHEN half_life < 1e-1 THEN 'too fast' WHEN half_life IS NULL OR half_life > 1800 THEN 'too slow' WHEN spread_std_bps < 3 THEN 'spread too small'
  WHEN daily_signals < 1 THEN 'too few signals' WHEN hedge_ratio <= 0 THEN 'negative ratio' ELSE 'ok' END AS verdict FROM scr""")


_LAGS = 8
_zs = ["s - s1", "s1", *[f"s{i} - s{i + 1}" for i in range(1, _LAGS + 1)]]
_gram = "[" + ", ".join("[" + ", ".join(f"sum(z{min(i, j)} * z{max(i, j)})" for j in range(_LAGS + 2)) + "]" for i in range(_LAGS + 2)) + "]"
_p2s = f"({pr.P_SMALL_2[0]} + {pr.P_SMALL_2[1]} * t + {pr.P_SMALL_2[2]} * t * t)"
_p2l = f"({pr.P_LARGE_2[0]} + {pr.P_LARGE_2[1]} * t + ({pr.P_LARGE_2[2]}) * t * t + ({pr.P_LARGE_2[3]}) * t * t * t)"
# each step solves one lag more by eliminating the next change from the products
_elim = ",\n".join(
    f"""m{p + 1} AS (SELECT symbol, n, list_transform(range(1, {_LAGS + 3}), lambda i: list_transform(range(1, {_LAGS + 3}),
  lambda j: m[i][j] - m[i][{p + 3}] * m[{p + 3}][j] / m[{p + 3}][{p + 3}])) AS m FROM m{p})""" for p in range(_LAGS))
_EG = f"""{_AL}, rs AS (SELECT al.symbol, ts_sec, y - hedge_ratio * x - intercept AS s FROM al JOIN hg USING (symbol)),
rl AS (SELECT symbol, s, {', '.join(f'lag(s, {i}) OVER (PARTITION BY symbol ORDER BY ts_sec) AS s{i}' for i in range(1, _LAGS + 2))} FROM rs),
rz AS (SELECT symbol, {', '.join(f'{z} AS z{i}' for i, z in enumerate(_zs))} FROM rl WHERE s{_LAGS + 1} IS NOT NULL),
m0 AS (SELECT symbol, count(*) AS n, {_gram} AS m FROM rz GROUP BY 1),
{_elim},
el AS ({' UNION ALL '.join(f'SELECT symbol, {p} AS lag, n, m[1][2] / m[2][2] AS g, m[1][1] - m[1][2] * m[1][2] / m[2][2] AS e, m[2][2] AS ss FROM m{p}' for p in range(_LAGS + 1))}),
et AS (SELECT *, g / sqrt(e / (n - lag - 1) / ss) AS t, n * ln(e / n) + 2 * (lag + 1) AS aic FROM el),
eg AS (SELECT *, t AS statistic, lag = arg_min(lag, (aic, lag)) OVER (PARTITION BY symbol) AS chosen,
  CASE WHEN t > {pr.TAU_MAX_2} THEN 1 WHEN t < {pr.TAU_MIN_2} THEN 0 WHEN t <= {pr.TAU_STAR_2} THEN {_cdf(_p2s)} ELSE {_cdf(_p2l)} END AS pvalue FROM et)"""
add("C15_cointegration", lambda s, d: pr.cointegration(_aligned(s, d), _LAGS), "symbol lag:l n:l statistic:4 aic:3 pvalue:7 chosen:b",
    f"{_EG}\nSELECT * FROM eg")


def _lots(s, d):
    p = _prices(s, d)
    last = p.groupBy("symbol").agg(F.max_by("price", "ts_sec").alias("price"))
    size = last.select("symbol", F.when(F.col("symbol") != "error", F.length("symbol") * 10).alias("lot_size"))
    return pr.lots(pr.hedge(_aligned(s, d)), last, size)


add("C17_pair_lots", _lots, "symbol price1:6 price2:6 lot1:l lot2:l lots1:l lots2:l",
    f"""{_AL}, lp AS (SELECT symbol, last(price ORDER BY ts_sec) AS price, CASE symbol WHEN 'error' THEN 75 ELSE length(symbol) * 10 END AS lot FROM pc GROUP BY 1)
SELECT hg.symbol, a.price AS price1, b.price AS price2, a.lot AS lot1, b.lot AS lot2, 1 AS lots1,
  greatest(1, round_even(a.price * a.lot * abs(hedge_ratio) / (b.price * b.lot), 0)) AS lots2
FROM hg JOIN lp a ON a.symbol = sym1 JOIN lp b ON b.symbol = sym2""")

_GRID = [(1.0, 0.0, 3.5), (1.0, 0.5, 2.0), (1.5, 0.3, 4.0)]


def _scored(s, d):
    a = _aligned(s, d)
    st = pr.hedge(a)
    z = a.join(st.select("symbol", "hedge_ratio"), "symbol").withColumn("s", F.col("y") - F.col("hedge_ratio") * F.col("x"))
    lvl = z.groupBy("symbol").agg(F.avg("s").alias("spread_mean"), F.stddev_pop("s").alias("spread_std"))
    return pr.zscores(a, st.join(lvl, "symbol"))


def _epi(s, d):
    return pr.threshold_episodes(_scored(s, d), _GRID, max_hold=6)


_gv = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _GRID)


def _fold(src):
    return f"""zi AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts_sec) - 1 AS i FROM {src}),
gr AS (SELECT * FROM (VALUES {_gv}) AS v(entry_z, exit_z, stop_z)),
st AS (SELECT symbol, date, entry_z, exit_z, stop_z, 0::BIGINT AS i, 0 AS dir, 0::BIGINT AS ei, FALSE AS closed, 0 AS cdir, 0::BIGINT AS cei, FALSE AS stp, FALSE AS tmo FROM (SELECT DISTINCT symbol, date FROM zi) q, gr
  UNION ALL SELECT n.symbol, n.date, s.entry_z, s.exit_z, s.stop_z, n.i,
    CASE WHEN s.dir = 0 THEN CASE WHEN n.z > s.entry_z THEN -1 WHEN n.z < -s.entry_z THEN 1 ELSE 0 END
      WHEN (s.dir = -1 AND (n.z < s.exit_z OR n.z > s.stop_z)) OR (s.dir = 1 AND (n.z > -s.exit_z OR n.z < -s.stop_z)) OR n.i - s.ei >= 6 THEN 0 ELSE s.dir END,
    CASE WHEN s.dir = 0 THEN n.i ELSE s.ei END,
    s.dir <> 0 AND ((s.dir = -1 AND (n.z < s.exit_z OR n.z > s.stop_z)) OR (s.dir = 1 AND (n.z > -s.exit_z OR n.z < -s.stop_z)) OR n.i - s.ei >= 6),
    s.dir, s.ei, (s.dir = -1 AND n.z > s.stop_z) OR (s.dir = 1 AND n.z < -s.stop_z), n.i - s.ei >= 6
  FROM st s JOIN zi n ON n.symbol = s.symbol AND n.date = s.date AND n.i = s.i + 1),
ep0 AS (SELECT st.symbol, st.date, entry_z, exit_z, stop_z, a.ts_sec AS entry_ts, b.ts_sec AS exit_ts, cdir AS direction, b.spread - a.spread AS spread_change,
  st.i - cei AS bars_held, a.y + a.x AS notional, stp AS is_stop, tmo AS is_timeout FROM st
  JOIN zi a ON a.symbol = st.symbol AND a.date = st.date AND a.i = cei JOIN zi b ON b.symbol = st.symbol AND b.date = st.date AND b.i = st.i WHERE closed),
ep AS (SELECT *, direction * spread_change - notional * 9 / 10000 AS net_pnl FROM ep0)"""


_EP = _AL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", zz AS (SELECT sp.*, s AS spread, (s - spread_mean) / greatest(spread_std, 1e-8) AS z FROM sp JOIN lv USING (symbol)),
{_fold('zz')}"""
add("C18_threshold_episodes", _epi,
    "symbol date:d entry_z:2 exit_z:2 stop_z:2 entry_ts:l exit_ts:l direction:l spread_change:5 bars_held:l net_pnl:5 is_stop:b is_timeout:b",
    f"{_EP}\nSELECT * FROM ep")
_SUM = f"""dy AS (SELECT symbol, entry_z, exit_z, stop_z, date, sum(net_pnl) AS p, count(*) AS n, count(*) FILTER (net_pnl > 0) AS w, sum(bars_held) AS b,
  count(*) FILTER (is_stop) AS s, count(*) FILTER (is_timeout) AS t FROM ep GROUP BY ALL),
su AS (SELECT symbol, entry_z, exit_z, stop_z, sum(n) AS n_trades, sum(w) / sum(n) AS win_rate, sum(p) AS total_pnl, sum(p) / 30 AS daily_pnl, sum(b) / sum(n) AS avg_hold,
  sum(s) / sum(n) AS stop_rate, sum(t) / sum(n) AS timeout_rate, coalesce(avg(p) / stddev(p) * sqrt(252), 0) AS sharpe FROM dy GROUP BY 1, 2, 3, 4)"""
add("C18_episode_summary", lambda s, d: pr.episode_summary(_epi(s, d), 30),
    "symbol entry_z:2 exit_z:2 stop_z:2 n_trades:l win_rate:6 total_pnl:4 daily_pnl:4 avg_hold:6 stop_rate:6 timeout_rate:6 sharpe:4",
    f"{_EP}, {_SUM}\nSELECT * FROM su")
add("C18_best_thresholds", lambda s, d: pr.best_thresholds(pr.episode_summary(_epi(s, d), 30)),
    "symbol entry_z:2 exit_z:2 stop_z:2 score:5",
    f"""{_EP}, {_SUM}, sc AS (SELECT *, daily_pnl * win_rate AS score FROM su WHERE n_trades >= 3 AND daily_pnl > 0)
SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, entry_z, exit_z, stop_z) = 1""")


def _trained(s, d):
    a = _aligned(s, d)
    return pr.trained_zscores(a, pr.hedge(a), 3, 10)


_TR = f"""{_AL}, dd AS (SELECT symbol, date, count(*) AS n, avg(s) AS m, var_pop(s) AS v FROM sp GROUP BY 1, 2),
tr AS (SELECT symbol, date, n, sum(n) FILTER (n > 10) OVER w AS tn, sum(n * m) FILTER (n > 10) OVER w AS ts, sum(n * (v + m * m)) FILTER (n > 10) OVER w AS tq, count(*) OVER w AS train_days FROM dd
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
trn AS (SELECT symbol, date, train_days, ts / tn AS train_mean, greatest(sqrt(greatest(tq / tn - (ts / tn) * (ts / tn), 0)), 1e-8) AS train_std FROM tr WHERE train_days >= 3 AND n > 10),
tz AS (SELECT sp.*, s AS spread, train_mean, train_std, train_days, (s - train_mean) / train_std AS z FROM sp JOIN trn USING (symbol, date))"""
add("W34_trained_zscore", _trained, "symbol ts_sec:l train_mean:5 train_std:5 train_days:l z:5", f"{_TR}\nSELECT * FROM tz")


def _oos(s, d):
    t = stage(_trained(s, d), "trained")
    e = pr.threshold_episodes(t, [_GRID[0]], max_hold=6)
    g = pr.grade(e, t.select("symbol", "date"))
    return g.withColumn("sector", F.when(F.col("symbol").rlike("click|view|signup"), "web").otherwise("shop"))


_WF = _TR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_fold('tz').replace(_gv, _gv.split('), ')[0] + ')')},
dy AS (SELECT symbol, date, sum(net_pnl) AS p, count(*) AS n, count(*) FILTER (net_pnl > 0) AS w FROM ep GROUP BY 1, 2),
dz AS (SELECT symbol, date, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM (SELECT DISTINCT symbol, date FROM tz) q LEFT JOIN dy USING (symbol, date)),
ga AS (SELECT symbol, sum(n) AS n_trades, sum(p) AS oos_pnl, avg(p) AS oos_daily, coalesce(sum(w) / nullif(sum(n), 0), 0) AS win_rate,
  CASE WHEN sum(n) = 0 THEN 0 ELSE coalesce(avg(p) / nullif(stddev_pop(p), 0) * sqrt(252), 0) END AS sharpe FROM dz GROUP BY 1),
gd AS (SELECT *, CASE WHEN sharpe >= 15e-1 AND win_rate >= 55e-2 AND oos_pnl > 0 THEN 'GREEN' WHEN sharpe >= 8e-1 AND win_rate >= 5e-1 AND oos_pnl > 0 THEN 'YELLOW'
  ELSE 'RED' END AS grade, CASE WHEN regexp_matches(symbol, 'click|view|signup') THEN 'web' ELSE 'shop' END AS sector FROM ga)"""
_G = "symbol n_trades:l oos_pnl:4 oos_daily:4 win_rate:6 sharpe:4 grade"
add("C19_walk_forward_pairs", _oos, _G, f"{_WF}\nSELECT * FROM gd")
add("A37_pair_grades", lambda s, d: _oos(s, d).groupBy("grade").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("oos_pnl").alias("pnl")),
    "grade n_pairs:l pnl:4", f"{_WF}\nSELECT grade, count(*) AS n_pairs, sum(oos_pnl) AS pnl FROM gd GROUP BY 1")
add("A38_sector_rollup", lambda s, d: pr.sector_rollup(_oos(s, d).withColumnRenamed("oos_daily", "daily_pnl")),
    "sector n_pairs:l daily_pnl:4 avg_sharpe:4 avg_win_rate:6",
    f"{_WF}\nSELECT sector, count(*) AS n_pairs, sum(oos_daily) AS daily_pnl, avg(sharpe) AS avg_sharpe, avg(win_rate) AS avg_win_rate FROM gd GROUP BY 1")
