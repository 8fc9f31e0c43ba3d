"""Parameters and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.data import _contract_bars, _expiry, _mstart, _sfx
from tickloom.catalog.standin import BAR, INSTRUMENTS, RESULTS, STORED, TICKS, instruments, results, table
from tickloom.operators import params as pm
from tickloom.plans import reports as rp
from tickloom.session import stage

_PAR = ["gamma", "kappa"]

# ---- ranking of result rows -------------------------------------------------------

_WF = f"""WITH {RESULTS}, w AS (SELECT *, avg(sharpe) OVER b AS ts, sum(net_pnl) OVER b AS tp, avg(net_pnl) OVER b AS am, stddev_pop(net_pnl) OVER b AS asd, count(*) OVER b AS bn,
  row_number() OVER (PARTITION BY symbol, gamma, kappa ORDER BY date) AS i FROM results
  WINDOW b AS (PARTITION BY symbol, gamma, kappa ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT symbol, gamma, kappa, count(*) AS n, avg(ts) AS ats, avg(CASE WHEN bn > 0 THEN CASE WHEN asd > 1e-12 THEN am / asd * sqrt(252) ELSE 0 END END) AS ats2, avg(tp) AS atp,
  avg(sharpe) FILTER (i > 1) AS tsh, sum(net_pnl) FILTER (i > 1) AS tpn, avg(sharpe) AS s1, sum(net_pnl) AS total_pnl, avg(net_pnl) AS avg_daily_pnl,
  count(*) FILTER (net_pnl > 0) AS profitable_days, stddev_pop(net_pnl) AS pnl_std FROM w GROUP BY 1, 2, 3),
wf AS (SELECT *, CASE WHEN n < 2 THEN s1 ELSE ats END AS train_sharpe, CASE WHEN n < 2 THEN s1 ELSE ats2 END AS train_sharpe2, CASE WHEN n < 2 THEN total_pnl ELSE atp END AS train_pnl,
  CASE WHEN n < 2 THEN s1 ELSE tsh END AS test_sharpe, CASE WHEN n < 2 THEN total_pnl ELSE tpn END AS test_pnl, CASE WHEN n < 2 THEN n ELSE n - 1 END AS test_days FROM g)"""
_WFC = ("symbol gamma:4 kappa:4 train_sharpe:5 train_pnl:2 test_sharpe:5 test_pnl:2 test_days:l total_pnl:2 avg_daily_pnl:3 "
        "profitable_days:l pnl_std:3")
add("A34_walk_forward", lambda s, d: pm.walk_forward(results(s, d), _PAR), _WFC, f"{_WF}\nSELECT * FROM wf")
add("A34_walk_forward_pnl", lambda s, d: pm.walk_forward(results(s, d), _PAR, "pnl"), "symbol gamma:4 kappa:4 train_sharpe:5 test_days:l",
    f"{_WF}\nSELECT symbol, gamma, kappa, train_sharpe2 AS train_sharpe, test_days FROM wf")
_BP = f"""{_WF}, rk AS (SELECT *, CASE WHEN test_days > 0 AND test_pnl > 0 THEN test_sharpe * profitable_days / test_days END AS sc FROM wf),
bp AS (SELECT *, coalesce(sc, 0) AS rank_score, sc IS NULL AS fallback FROM rk
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sc DESC NULLS LAST, CASE WHEN sc IS NULL THEN train_sharpe END DESC NULLS LAST, gamma, kappa) = 1)"""
add("A35_best_params", lambda s, d: pm.best_params(pm.walk_forward(results(s, d), _PAR), _PAR),
    "symbol gamma:4 kappa:4 rank_score:5 fallback:b", f"{_BP}\nSELECT * FROM bp")
_CB = f"""WITH {RESULTS}, dy AS (SELECT gamma, kappa, date, sum(net_pnl) AS p, count(*) AS n, count(*) FILTER (net_pnl > 0) AS k FROM results GROUP BY 1, 2, 3),
cb AS (SELECT gamma, kappa, avg(p) AS mean_daily_pnl, stddev(p) AS std_daily_pnl, avg(p) / stddev(p) AS sharpe, avg(CAST(p > 0 AS INTEGER)) * 100 AS pct_profit_days,
  sum(k) / sum(n) * 100 AS pct_symbol_profit, min(p) AS min_daily_pnl, max(p) AS max_daily_pnl, sum(n) AS n_valid FROM dy GROUP BY 1, 2)"""
add("A36_combo_stats", lambda s, d: pm.combo_stats(results(s, d), _PAR),
    "gamma:4 kappa:4 mean_daily_pnl:3 std_daily_pnl:3 sharpe:6 pct_profit_days:6 pct_symbol_profit:6 min_daily_pnl:3 max_daily_pnl:3 n_valid:l",
    f"{_CB}\nSELECT * FROM cb")
_BC = f"""WITH {RESULTS}, g AS (SELECT symbol, gamma, kappa, avg(net_pnl) AS mean_pnl, stddev(net_pnl) AS std_pnl, avg(CAST(net_pnl > 0 AS INTEGER)) * 100 AS pct_profit FROM results GROUP BY 1, 2, 3),
s AS (SELECT *, mean_pnl / greatest(std_pnl, 1) AS sharpe FROM g),
bc AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pct_profit >= 45 DESC, sharpe DESC NULLS LAST, gamma, kappa) = 1)"""
add("A36_best_consistent", lambda s, d: pm.best_consistent(results(s, d), _PAR, 45.0),
    "symbol gamma:4 kappa:4 mean_pnl:3 sharpe:6 pct_profit:6", f"{_BC}\nSELECT * FROM bc")


add("C22_best_of_grid", lambda s, d: rp.best_of_grid(stage(results(s, d), "results"), _PAR, 45.0), "symbol gamma:4 kappa:4 rank_score:5 fallback:b steady_gamma:4 steady_kappa:4",
    f"{_BP}, g2 AS (SELECT symbol, gamma, kappa, avg(net_pnl) AS mean_pnl, stddev(net_pnl) AS std_pnl, avg(CAST(net_pnl > 0 AS INTEGER)) * 100 AS pct_profit FROM results GROUP BY 1, 2, 3), "
    "s2 AS (SELECT *, mean_pnl / greatest(std_pnl, 1) AS sharpe FROM g2), "
    "bc AS (SELECT symbol, gamma AS steady_gamma, kappa AS steady_kappa FROM s2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pct_profit >= 45 DESC, sharpe DESC NULLS LAST, gamma, kappa) = 1)"
    "\nSELECT * FROM bp JOIN bc USING (symbol)")


def _two_models(s, d):
    r = table(s, d, "orders").selectExpr("o_custkey", "o_orderpriority", "o_totalprice * 987654321e-9 - 251237.731e0 AS net_pnl")
    one = r.where("o_orderpriority = '5-LOW'").groupBy(F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("26MAYFUT")).alias("symbol")).agg(F.sum("net_pnl").alias("net_pnl"))
    two = r.where("o_orderpriority = '2-HIGH'").groupBy(F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("26JUNFUT")).alias("symbol")).agg(F.sum("net_pnl").alias("net_pnl"))
    return one, two


_CM = """WITH r AS (SELECT o_custkey, o_orderpriority, o_totalprice * 987654321e-9 - 251237.731e0 AS net_pnl FROM orders),
a AS (SELECT 'S' || o_custkey AS base, sum(net_pnl) AS pnl_1 FROM r WHERE o_orderpriority = '5-LOW' GROUP BY 1), b AS (SELECT 'S' || o_custkey AS base, sum(net_pnl) AS pnl_2 FROM r WHERE o_orderpriority = '2-HIGH' GROUP BY 1),
j AS (SELECT *, CASE WHEN pnl_2 IS NULL OR pnl_1 >= pnl_2 THEN 'V1' ELSE 'V2' END AS route FROM a FULL JOIN b USING (base)),
cm AS (SELECT *, CASE route WHEN 'V1' THEN pnl_1 ELSE pnl_2 END AS best, greatest(CASE route WHEN 'V1' THEN pnl_1 ELSE pnl_2 END, 0) AS hybrid FROM j)"""
add("J13_model_comparison", lambda s, d: pm.compare_models(*_two_models(s, d)), "base pnl_1:3 pnl_2:3 route best:3 hybrid:3", f"{_CM}\nSELECT * FROM cm")
add("J13_comparison_totals", lambda s, d: pm.comparison_totals(pm.compare_models(*_two_models(s, d))),
    "total_1:2 total_2:2 hybrid_total:2 n_route_1:l n_route_2:l",
    f"""{_CM}
SELECT sum(pnl_1) AS total_1, sum(pnl_2) AS total_2, sum(hybrid) AS hybrid_total, count(*) FILTER (route = 'V1') AS n_route_1, count(*) FILTER (route = 'V2') AS n_route_2 FROM cm""")


def _sharpes(s, d, gamma):
    return results(s, d).where(F.col("gamma") == gamma).groupBy("symbol").agg((F.avg("net_pnl") / F.stddev_samp("net_pnl")).alias("sharpe"))


add("C31_result_comparison", lambda s, d: pm.compare_sharpe(_sharpes(s, d, 0.01), _sharpes(s, d, 0.02)),
    "symbol sharpe_base:6 sharpe_other:6 improvement_pct:4 verdict",
    f"""WITH {RESULTS}, a AS (SELECT symbol, avg(net_pnl) / stddev(net_pnl) AS sb FROM results WHERE gamma = 1e-2 GROUP BY 1), b AS (SELECT symbol, avg(net_pnl) / stddev(net_pnl) AS so FROM results WHERE gamma = 2e-2 GROUP BY 1),
p AS (SELECT symbol, sb AS sharpe_base, so AS sharpe_other, (so - sb) / greatest(abs(sb), 1e-1) * 100 AS improvement_pct FROM a JOIN b USING (symbol))
SELECT *, CASE WHEN improvement_pct > 5 THEN 'IMPROVE' WHEN abs(improvement_pct) <= 5 THEN 'neutral' ELSE 'worse' END AS verdict FROM p""")

# ---- parameter sets -----------------------------------------------------------------


def _rows(s, d):
    """One parameter set per instrument of part: the brand's number and the size give the values."""
    i = instruments(s, d).groupBy("symbol").agg(F.min("p_size").alias("z"), F.min("p_retailprice").alias("r"))
    return i.selectExpr(
        "symbol", "stack(4, 'gamma', z / 400, 'kappa', r / 170, 'min_spread', (z - 2) / 10, 'open_mult', z / 8) AS (key, value)"
    ).where("NOT (key = 'min_spread' AND value > 4)")


_ROWS = f"""{INSTRUMENTS}, ip AS (SELECT symbol, min(p_size) AS z, min(p_retailprice) AS r FROM instruments GROUP BY 1),
prow AS (SELECT * FROM (SELECT symbol, 'gamma' AS key, z / 400 AS value FROM ip UNION ALL SELECT symbol, 'kappa', r / 170 FROM ip UNION ALL
  SELECT symbol, 'min_spread', (z - 2) / 10 FROM ip UNION ALL SELECT symbol, 'open_mult', z / 8 FROM ip) q WHERE NOT (key = 'min_spread' AND value > 4))"""
_bnd = ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in pm.BOUNDS.items())
_ISS = f"""{_ROWS}, bd AS (SELECT * FROM (VALUES {_bnd}) AS v(key, lo, hi)),
iss AS (SELECT symbol, key, 'out of range' AS issue FROM prow JOIN bd USING (key) WHERE value < lo OR value > hi UNION ALL
  SELECT symbol, 'min_spread', 'missing' FROM prow GROUP BY symbol HAVING count(*) FILTER (key = 'min_spread') = 0)"""
add("A40_param_issues", lambda s, d: pm.health_issues(_rows(s, d)), "symbol key issue", f"WITH {_ISS}\nSELECT * FROM iss")
add("A40_param_health", lambda s, d: pm.health(_rows(s, d), "2026-05-20", "2026-05-19"), "n_symbols:l n_issues:l n_bad_symbols:l age_days:l status",
    f"""WITH {_ISS}
SELECT (SELECT count(DISTINCT symbol) FROM prow) AS n_symbols, count(*) AS n_issues, count(DISTINCT symbol) AS n_bad_symbols, 1 AS age_days,
  CASE WHEN (SELECT count(DISTINCT symbol) FROM prow) < 50 THEN 'CRITICAL' WHEN count(*) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM iss""")


def _wanted(s, d):
    """Every instrument, the same base one contract on, and brands without any parameters."""
    i = instruments(s, d)
    nxt = i.where("p_size % 6 = 0").select(F.concat("name", F.lit("26DECFUT")).alias("symbol"))
    return i.select("symbol").unionByName(nxt).unionByName(i.select(F.concat("p_brand", F.lit("26DECFUT")).alias("symbol"))).distinct()


_DEF = {"gamma": 0.01, "kappa": 1.5, "min_spread": 0.1, "open_mult": 1.5}
_WANT = """want AS (SELECT symbol FROM instruments UNION SELECT name || '26DECFUT' FROM instruments WHERE p_size % 6 = 0 UNION SELECT p_brand || '26DECFUT' FROM instruments)"""
_RES = f"""{_ROWS}, {_WANT}, pw AS (SELECT symbol, regexp_replace(symbol, '{_sfx}', '') AS base, max(value) FILTER (key = 'gamma') AS gamma, max(value) FILTER (key = 'kappa') AS kappa,
  max(value) FILTER (key = 'min_spread') AS min_spread, max(value) FILTER (key = 'open_mult') AS open_mult FROM prow GROUP BY 1),
pb AS (SELECT * FROM pw QUALIFY row_number() OVER (PARTITION BY base ORDER BY CASE WHEN regexp_matches(symbol, '{_sfx}') THEN {_mstart('symbol')} END DESC NULLS LAST, symbol DESC) = 1),
rs AS (SELECT w.symbol, CASE WHEN e.symbol IS NOT NULL THEN 'exact' WHEN b.symbol IS NOT NULL THEN 'base' ELSE 'default' END AS layer, CASE WHEN e.symbol IS NULL THEN b.symbol END AS base_symbol,
  {', '.join(f"coalesce(CASE WHEN e.symbol IS NOT NULL THEN e.{k} ELSE b.{k} END, {v}::DOUBLE) AS {k}" for k, v in _DEF.items())}
  FROM want w LEFT JOIN pw e ON e.symbol = w.symbol LEFT JOIN pb b ON b.base = regexp_replace(w.symbol, '{_sfx}', ''))"""
_RC = "symbol layer base_symbol gamma:6 kappa:6 min_spread:6 open_mult:6"
add("J11_param_lookup", lambda s, d: pm.resolve(_wanted(s, d), pm.as_maps(_rows(s, d)), _DEF), _RC, f"WITH {_RES}\nSELECT * FROM rs")


def _newer(s, d):
    return _rows(s, d).where("symbol NOT LIKE 'SMALL%'").selectExpr("symbol", "key", "value * 1.3 + 0.01 AS value").where("key <> 'kappa'")


_BL = f"""{_ROWS}, nwr AS (SELECT symbol, key, value * 13e-1 + 1e-2 AS value FROM prow WHERE symbol NOT LIKE 'SMALL%' AND key <> 'kappa'),
bl AS (SELECT symbol, key, coalesce(round(6e-1 * o.value + 4e-1 * n.value, 6), n.value, o.value) AS value FROM prow o FULL JOIN nwr n USING (symbol, key))"""
add("J12_param_blend", lambda s, d: pm.blend(_rows(s, d).where("symbol NOT LIKE 'RED%'"), _newer(s, d)), "symbol key value:5",
    f"WITH {_BL.replace('FROM prow o FULL', 'FROM (SELECT * FROM prow WHERE symbol NOT LIKE ' + chr(39) + 'RED%' + chr(39) + ') o FULL')}\nSELECT * FROM bl")


_C21 = f"""{_BL}, prow2 AS (SELECT * FROM bl), {_RES.replace(_ROWS + ', ', '').replace('FROM prow GROUP', 'FROM prow2 GROUP')},
bd AS (SELECT * FROM (VALUES {_bnd}) AS v(key, lo, hi)), is0 AS (SELECT symbol FROM prow2 JOIN bd USING (key) WHERE value < lo OR value > hi UNION ALL
  SELECT symbol FROM prow2 GROUP BY symbol HAVING count(*) FILTER (key = 'min_spread') = 0), isn AS (SELECT symbol AS src, count(*) AS n FROM is0 GROUP BY 1)"""
add("C21_param_resolution", lambda s, d: rp.resolved_params(_wanted(s, d), _rows(s, d), _newer(s, d), _DEF), _RC.replace(":6", ":5") + " n_issues:l",
    f"WITH {_C21}\nSELECT rs.*, coalesce(n, 0) AS n_issues FROM rs LEFT JOIN isn ON src = coalesce(base_symbol, symbol)")


def _cprices(s, d):
    return _contract_bars(s, d).select(F.col("contract").alias("symbol"), "date", "ts_sec", F.coalesce("weighted_mid", "close").alias("price"))


def _rolls(s, d):
    c = _cprices(s, d).select("symbol").distinct().where("symbol LIKE '%24JANFUT'")
    return c.select(F.col("symbol").alias("old_symbol"), F.regexp_replace("symbol", "JAN", "FEB").alias("new_symbol"))


def _ratios(s, d):
    p = stage(_cprices(s, d), "prices")
    return pm.roll_ratios(p, _rolls(s, d), min_rows=20)


_CP = f"""WITH {TICKS}, {STORED}, ct AS (SELECT t.*, contract AS c, (ts_local_ns // 1000000000) // {BAR} * {BAR} AS ts_sec FROM ticks t JOIN stored ON t.tick_id = event_id),
cp AS (SELECT c AS symbol, ts_sec, DATE '1970-01-01' + CAST((ts_sec + 19800) // 86400 AS INTEGER) AS date,
  last((bid_p1 * ask_q1 + ask_p1 * bid_q1) / (bid_q1 + ask_q1) ORDER BY ts_local_ns, tick_id) AS price FROM ct GROUP BY 1, 2),
cd AS (SELECT DISTINCT symbol, date FROM cp), ck AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rl, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rf FROM cd),
ed AS (SELECT cp.*, 'o' AS k FROM cp JOIN ck USING (symbol, date) WHERE rl <= 3 AND symbol LIKE '%JANFUT' UNION ALL SELECT cp.*, 'n' FROM cp JOIN ck USING (symbol, date) WHERE rf <= 2 AND symbol LIKE '%FEBFUT'),
rn AS (SELECT symbol, count(*) AS n FROM ed GROUP BY 1),
rr AS (SELECT symbol, ts_sec, ln(price + 1e-10) - ln(lag(price) OVER (PARTITION BY symbol ORDER BY ts_sec) + 1e-10) AS r FROM ed),
rq AS (SELECT symbol, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM rr GROUP BY 1),
rt AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts_sec DESC) - 1 AS k FROM rr JOIN rq USING (symbol) WHERE r BETWEEN lo AND hi),
wm AS (SELECT symbol, sum(pow(95e-2, k)) AS w, sum(pow(95e-2, 2 * k)) AS w2, sum(pow(95e-2, k) * r) / sum(pow(95e-2, k)) AS m FROM rt GROUP BY 1 HAVING count(*) >= 10),
vol AS (SELECT symbol, sqrt(sum(pow(95e-2, k) * (r - m) * (r - m)) / any_value(w) * any_value(w) * any_value(w) / (any_value(w) * any_value(w) - any_value(w2))) * sqrt(23400 * 252) AS vol FROM rt JOIN wm USING (symbol) GROUP BY 1),
pe AS (SELECT symbol, median(price) AS price FROM (SELECT cp.* FROM cp JOIN ck USING (symbol, date) WHERE rl = 1 AND symbol LIKE '%JANFUT' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_sec DESC) <= 100) q GROUP BY 1
  UNION ALL SELECT symbol, median(price) FROM (SELECT cp.* FROM cp JOIN ck USING (symbol, date) WHERE rf = 1 AND symbol LIKE '%FEBFUT' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_sec) <= 100) q GROUP BY 1),
rat AS (SELECT o.symbol AS old_symbol, n.symbol AS new_symbol, vo.vol AS old_vol, vn.vol AS new_vol,
  CASE WHEN ro.n >= 20 AND rw.n >= 20 THEN least(greatest(vn.vol / vo.vol, 5e-1), 2) ELSE 1 END AS vol_ratio, least(greatest(n.price / o.price, 7e-1), 13e-1) AS price_ratio
  FROM pe o JOIN pe n ON n.symbol = replace(o.symbol, 'JAN', 'FEB') AND o.symbol LIKE '%JANFUT' LEFT JOIN vol vo ON vo.symbol = o.symbol LEFT JOIN vol vn ON vn.symbol = n.symbol
  LEFT JOIN rn ro ON ro.symbol = o.symbol LEFT JOIN rn rw ON rw.symbol = n.symbol)"""
add("C20_roll_ratios", _ratios, "old_symbol new_symbol old_vol:4 new_vol:4 vol_ratio:6 price_ratio:6", f"{_CP}\nSELECT * FROM rat")


def _old_rows(s, d):
    """Old parameters per contract, from its own mean spread and price."""
    b = _contract_bars(s, d).groupBy(F.col("contract").alias("symbol")).agg(F.avg("spread_mean").alias("m"), F.avg("close").alias("c"))
    return b.selectExpr("symbol", "stack(4, 'gamma', m / 10, 'kappa', c / 20, 'min_spread', m, 'open_mult', 1.5 + m) AS (key, value)")


_tb = ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in pm.TRANSFER.items())
add("C20_param_transfer", lambda s, d: pm.transfer(_old_rows(s, d), _ratios(s, d)), "symbol new_symbol key old_value:6 value:5 is_valid:b",
    f"""{_CP}, bb AS (SELECT c AS symbol, ts_sec, stored_layout, avg(spread) AS sm, last(last_price ORDER BY ts_local_ns, tick_id) AS cl FROM (SELECT ct.*, c AS stored_layout FROM ct) q GROUP BY 1, 2, 3),
bm AS (SELECT symbol, avg(sm) AS m, avg(cl) AS c FROM bb GROUP BY 1),
pr AS (SELECT symbol, 'gamma' AS key, m / 10 AS v FROM bm UNION ALL SELECT symbol, 'kappa', c / 20 FROM bm UNION ALL SELECT symbol, 'min_spread', m FROM bm UNION ALL SELECT symbol, 'open_mult', 15e-1 + m FROM bm),
tb AS (SELECT * FROM (VALUES {_tb}) AS x(key, lo, hi)),
sc AS (SELECT symbol, new_symbol, key, v, least(greatest(v * CASE key WHEN 'kappa' THEN sqrt(vol_ratio) WHEN 'open_mult' THEN 1 + (vol_ratio - 1) * 3e-1 ELSE vol_ratio END, v * lo), v * hi) AS nv
  FROM pr JOIN rat ON old_symbol = symbol JOIN tb USING (key))
SELECT symbol, new_symbol, key, v AS old_value, nv AS value, TRUE AS is_valid FROM sc""")
