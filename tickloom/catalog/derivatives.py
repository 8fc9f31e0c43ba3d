"""Option bars, chains, implied volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import (
    BAR, FEED, INSTRUMENTS, OBARS, feed_bars, instruments, option_ticks,
)
from tickloom.catalog.data import PARSED
from tickloom.functions import pricing
from tickloom.functions import symbols as sy
from tickloom.operators import options as op
from tickloom.session import stage


def _obars(s, d):
    return op.option_bars(option_ticks(s, d), BAR)


def _spot(s, d):
    return op.spot_series(*feed_bars(s, d))


def _terms(s, d):
    return sy.parse_options(_obars(s, d))


_TERMS = f"""{OBARS}, ob AS (SELECT *, volume_cumulative AS volume, regexp_extract(symbol, '^([A-Z]+)', 1) AS underlying,
  CAST(regexp_extract(symbol, '24FEB([0-9]+)', 1) AS DOUBLE) AS strike, right(symbol, 2) AS opt_type, DATE '2024-02-29' AS expiry FROM obars), {FEED}"""
_JOIN = f"""{_TERMS}, j0 AS (SELECT ob.*, spot.spot_price AS s0 FROM ob LEFT JOIN spot ON ob.underlying = spot.underlying AND ob.ts_sec = spot.ts_sec),
j AS (SELECT *, coalesce(last_value(s0 IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY ts_sec ROWS UNBOUNDED PRECEDING),
  first_value(s0 IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY ts_sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS spot_price FROM j0),
ch AS (SELECT *, greatest((expiry - date) / 365e0, 1 / 365e0) AS tte, (spot_price - strike) / spot_price AS moneyness FROM j)"""

add("A3_option_bars", _obars,
    "symbol ts_sec open:6 high:6 low:6 close:6 volume:l tick_count:l oi:l spread_mean:7 spread_max:6 imbalance_mean:7 imbalance_last:7 "
    "total_bid_qty:l total_ask_qty:l bid_p1:6 ask_p1:6",
    f"{OBARS}\nSELECT *, volume_cumulative AS volume FROM obars")
add("J3_spot_fallback", _spot, "underlying ts_sec spot_price:6 source", f"{_TERMS}\nSELECT * FROM spot")


def _joined(s, d):
    return op.with_spot(_terms(s, d), _spot(s, d))


def _priced(s, d):
    j = _joined(s, d)
    return j.withColumns({"tte": op.time_to_expiry(F.col("expiry"), F.col("date")),
                          "moneyness": op.moneyness(F.col("spot_price"), F.col("strike"))})


add("J2_option_spot_join", _joined, "symbol ts_sec close:6 spot_price:6", f"{_JOIN}\nSELECT * FROM ch")
add("W36_fill_both_ways", _joined, "symbol ts_sec spot_price:6", f"{_JOIN}\nSELECT * FROM ch")
add("F7_time_to_expiry", _priced, "symbol ts_sec tte:8", f"{_JOIN}\nSELECT * FROM ch")
add("F8_moneyness", _priced, "symbol ts_sec moneyness:7", f"{_JOIN}\nSELECT * FROM ch")


def _poly(cs, x):
    out = f"{cs[0]:e}"
    for c in cs[1:]:
        out = f"({out} * {x} + {c:.17e})"
    return out


def _phi(x):
    a = f"least(abs({x}), 37)"
    tail = f"exp(-{a} * {a} / 2) * {_poly(pricing.NUM, a)} / {_poly(pricing.DEN, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 65e-2))))) / 2.506628274631e0"
    t = f"(CASE WHEN {a} < 7.07106781186547e0 THEN {tail} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {t} ELSE {t} END)"


def _price(src, v):
    """Price at volatility column v; puts by put-call parity."""
    return f"""(SELECT *, CASE opt_type WHEN 'CE' THEN call ELSE call - spot_price + strike * exp(-7e-2 * tte) END AS px FROM (
  SELECT *, spot_price * {_phi('d1')} - strike * exp(-7e-2 * tte) * {_phi('d2')} AS call FROM (
  SELECT *, d1 - {v} * sqrt(tte) AS d2 FROM (
  SELECT *, (ln(spot_price / strike) + (7e-2 + {v} * {v} / 2) * tte) / ({v} * sqrt(tte)) AS d1 FROM {src}))))"""


_IV = _JOIN.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
c0 AS (SELECT symbol, ts_sec, close, spot_price, strike, tte, opt_type, 1e-3 AS lo, 2e1 AS hi FROM ch WHERE spot_price IS NOT NULL),
bis AS (SELECT symbol, ts_sec, close, spot_price, strike, tte, opt_type, lo, hi, (lo + hi) / 2 AS v, 0 AS n FROM c0
  UNION ALL SELECT symbol, ts_sec, close, spot_price, strike, tte, opt_type, l2, h2, (l2 + h2) / 2, n + 1 FROM (
    SELECT *, CASE WHEN px < close THEN v ELSE lo END AS l2, CASE WHEN px < close THEN hi ELSE v END AS h2 FROM {_price('bis', 'v')} WHERE n < 60)),
fin AS (SELECT * FROM bis WHERE n = 60),
b1 AS (SELECT symbol, ts_sec, px AS plo FROM {_price('c0', 'lo')}), b2 AS (SELECT symbol, ts_sec, px AS phi FROM {_price('c0', 'hi')}),
iv0 AS (SELECT f.*, f.v AS iv FROM {_price('fin', 'v')} f JOIN b1 USING (symbol, ts_sec) JOIN b2 USING (symbol, ts_sec)
  WHERE plo <= close AND phi >= close AND v < 20 AND close >= 999e-3 * greatest(0, CASE opt_type WHEN 'CE' THEN spot_price - strike ELSE strike - spot_price END)),
gk AS (SELECT symbol, ts_sec, iv, CASE opt_type WHEN 'CE' THEN {_phi('d1')} ELSE {_phi('d1')} - 1 END AS delta,
  exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot_price * iv * sqrt(tte)) AS gamma, spot_price * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(tte) / 100 AS vega,
  (-(spot_price * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * iv) / (2 * sqrt(tte)) - 7e-2 * strike * exp(-7e-2 * tte) *
    (CASE opt_type WHEN 'CE' THEN {_phi('d2')} ELSE 1 - {_phi('d2')} END)) / 365 AS theta FROM iv0),
enr AS (SELECT ch.*, iv, delta, gamma, vega, theta FROM ch LEFT JOIN gk USING (symbol, ts_sec))"""


def _ivcols(s, d):
    p = _priced(s, d)
    g = pricing.iv_greeks(F.col("close"), F.col("spot_price"), F.col("strike"), F.col("tte"), F.col("opt_type"))
    return p.withColumn("_g", g).select("symbol", "ts_sec", "_g.*")


def _chain(s, d):
    return op.enrich_chain(_obars(s, d), _spot(s, d), mean_rows=5, z_rows=8)


add("C4_implied_vol_greeks", _ivcols, "symbol ts_sec iv:5 delta:5 gamma:5 vega:5 theta:5", f"{_IV}\nSELECT * FROM enr")


def _w(n):
    return f"(PARTITION BY symbol, date ORDER BY ts_sec ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ENR = f"""{_IV}, wv AS (SELECT *, CASE WHEN count(iv) OVER {_w(5)} = 5 THEN avg(iv) OVER {_w(5)} END AS iv_ma_60s,
  CASE WHEN count(iv) OVER {_w(8)} = 8 AND stddev(iv) OVER {_w(8)} > 1e-12 THEN (iv - avg(iv) OVER {_w(8)}) / stddev(iv) OVER {_w(8)} END AS iv_zscore FROM enr)"""
add("C3_option_chain", _chain,
    "symbol ts_sec date:d close:6 underlying strike:2 opt_type expiry:d spot_price:6 tte:8 moneyness:7 iv:5 delta:5 vega:5 iv_ma_60s:5 iv_zscore:4",
    f"{_ENR}\nSELECT * FROM wv")
add("W7_iv_windows", _chain, "symbol ts_sec iv_ma_60s:5 iv_zscore:4", f"{_ENR}\nSELECT * FROM wv")
add("S5_option_scan", lambda s, d: op.select_options(_priced(s, d), "CE", (20, 30), 1.0, 0.12), "symbol ts_sec close:6 strike:2",
    f"{_JOIN}\nSELECT * FROM ch WHERE opt_type = 'CE' AND strike BETWEEN 20 AND 30 AND close >= 1 AND tte <= 12e-2 AND (ts_sec + 19800) % 86400 BETWEEN 33300 AND 55800")
add("S6_chain_snapshot", lambda s, d: op.chain_snapshots(_priced(s, d), 5.0, 1), "symbol ts_sec strike:2 atm:2 close:6",
    f"""{_JOIN}, a AS (SELECT *, round_even(spot_price / 5, 0) * 5 AS atm FROM ch)
SELECT * FROM a WHERE close > 5e-1 AND abs(strike - atm) <= 5""")
add("P8_quotable_options", lambda s, d: op.quotable(_chain(s, d), 1.0, 6.0, 0.6), "symbol ts_sec close:6",
    f"{_IV}\nSELECT * FROM enr WHERE close BETWEEN 1 AND 6 AND abs(delta) <= 6e-1 AND iv > 0")
add("J10_future_lookup", lambda s, d: op.with_future(_terms(s, d), feed_bars(s, d)[1].where("symbol LIKE '%FEBFUT'")),
    "symbol ts_sec close:6 future_price:6",
    f"{_TERMS}\nSELECT ob.symbol, ob.ts_sec, ob.close, fb.close AS future_price FROM ob LEFT JOIN fb ON fb.kind = 1 AND fb.underlying = ob.underlying AND fb.ts_sec = ob.ts_sec")
add("A29_option_quality", lambda s, d: op.quality(_chain(s, d)),
    "underlying date:d n_bars:l n_symbols:l good_bars:l avg_premium:9 avg_iv:4 avg_abs_delta:5 first_ts:l last_ts:l",
    f"""{_IV}
SELECT underlying, date, count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols, count(*) FILTER (close > 1 AND iv > 0) AS good_bars,
  avg(close) FILTER (close > 1) AS avg_premium, avg(iv) FILTER (iv > 0) AS avg_iv, avg(abs(delta)) AS avg_abs_delta,
  min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM enr GROUP BY 1, 2""")


def _listed(s, d):
    return sy.parse_options(instruments(s, d)).where("expiry IS NOT NULL")


_L = f"WITH {INSTRUMENTS}, {PARSED}, ls AS (SELECT * FROM parsed WHERE expiry IS NOT NULL)"
add("O4_nearest_expiries", lambda s, d: op.nearest_expiries(_listed(s, d), "2025-06-01", 2), "p_partkey:l symbol underlying expiry:d",
    f"{_L}\nSELECT * FROM ls WHERE expiry >= DATE '2025-06-01' QUALIFY dense_rank() OVER (PARTITION BY underlying ORDER BY expiry) <= 2")
add("O5_strikes_around_middle", lambda s, d: op.around_middle(_listed(s, d), 50.0, 3), "p_partkey:l symbol underlying expiry:d strike:2 atm:2",
    f"""{_L}, st AS (SELECT DISTINCT underlying, expiry, strike FROM ls),
r AS (SELECT *, row_number() OVER (PARTITION BY underlying, expiry ORDER BY strike) - 1 AS i, count(*) OVER (PARTITION BY underlying, expiry) AS n FROM st),
m AS (SELECT underlying, expiry, round_even(strike / 50, 0) * 50 AS atm FROM r WHERE i = n // 2)
SELECT * FROM ls JOIN m USING (underlying, expiry) WHERE abs(strike - atm) <= 150 AND (strike - atm) % 50 = 0""")


def _sets(s, d):
    master = _terms(s, d).select("underlying", "strike").distinct()
    out = op.strike_sets(_spot(s, d), master, 1.0, 5, 1800, 2)
    return out.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: x.cast("int").cast("string"))) for c in ("to_add", "to_remove", "strikes")})


_SETS = _TERMS.replace("WITH ", "WITH RECURSIVE ", 1) + """, sl0 AS (SELECT underlying, ts_sec // 1800 * 1800 AS slot, last(spot_price ORDER BY ts_sec) AS price FROM spot GROUP BY 1, 2),
sl AS (SELECT underlying, slot, round_even(price, 0) AS atm, DATE '1970-01-01' + CAST((slot + 19800) // 86400 AS INTEGER) AS date,
  row_number() OVER (PARTITION BY underlying, (slot + 19800) // 86400 ORDER BY slot) AS i FROM sl0),
fo AS (SELECT underlying, date, slot, atm, i, atm AS cur, TRUE AS chg FROM sl WHERE i = 1 UNION ALL
  SELECT n.underlying, n.date, n.slot, n.atm, n.i, CASE WHEN abs(n.atm - f.cur) >= 2 THEN n.atm ELSE f.cur END, abs(n.atm - f.cur) >= 2
  FROM fo f JOIN sl n ON n.underlying = f.underlying AND n.date = f.date AND n.i = f.i + 1),
ka AS (SELECT underlying, date, slot, atm, lag(atm) OVER (PARTITION BY underlying, date ORDER BY slot) AS old_atm FROM fo WHERE chg),
kl AS (SELECT DISTINCT underlying, strike FROM ob),
sets AS (SELECT ka.underlying, ka.date, slot, atm, old_atm,
  coalesce(string_agg(CAST(CAST(strike AS INTEGER) AS VARCHAR), ',' ORDER BY strike) FILTER (abs(strike - atm) <= 5), '') AS strikes,
  coalesce(string_agg(CAST(CAST(strike AS INTEGER) AS VARCHAR), ',' ORDER BY strike) FILTER (abs(strike - atm) <= 5 AND NOT coalesce(abs(strike - old_atm) <= 5, FALSE)), '') AS to_add,
  coalesce(string_agg(CAST(CAST(strike AS INTEGER) AS VARCHAR), ',' ORDER BY strike) FILTER (abs(strike - old_atm) <= 5 AND NOT abs(strike - atm) <= 5), '') AS to_remove
  FROM ka JOIN kl USING (underlying) GROUP BY 1, 2, 3, 4, 5)"""
add("J14_strike_changes", _sets, "underlying date:d slot:l atm:2 old_atm:2 to_add to_remove", f"{_SETS}\nSELECT * FROM sets")
add("U7_strike_set_difference", _sets, "underlying slot:l strikes to_add to_remove", f"{_SETS}\nSELECT * FROM sets")
