"""Ledgers over a table of fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.derivatives import _JOIN, _priced
from tickloom.catalog.standin import FILL_ORDER, FILLS, OPTION_TICKS, fills, option_ticks
from tickloom.functions.columns import ist_date
from tickloom.operators import ledger as lg
from tickloom.plans import reports as rp
from tickloom.session import stage

_r = {k: "CASE instrument_type " + " ".join(f"WHEN '{n}' THEN {r[k]!r}::DOUBLE" for n, r in lg.RATES.items()) + " END"
      for k in ("stt", "exchange", "sebi", "stamp", "brokerage")}
_COST = f"""c0 AS (SELECT *, price * quantity * lot_size AS val FROM fills),
c1 AS (SELECT *, CASE side WHEN 'SELL' THEN val * {_r['stt']} ELSE 0 END AS stt, CASE side WHEN 'BUY' THEN val * {_r['stamp']} ELSE 0 END AS stamp,
  val * {_r['exchange']} AS exchange, val * {_r['sebi']} AS sebi, {_r['brokerage']} AS brokerage FROM c0),
cost AS (SELECT *, (brokerage + exchange + sebi) * 18e-2 AS gst, stt + stamp + exchange + sebi + brokerage + (brokerage + exchange + sebi) * 18e-2 AS cost FROM c1)"""
_ORD = ", ".join(FILL_ORDER)
_ID = "symbol date:d l_orderkey:l l_linenumber:l l_partkey:l quantity:l l_tax:2"

add("A30_transaction_costs", lambda s, d: lg.with_costs(fills(s, d)),
    f"{_ID} stt:6 stamp:6 exchange:6 sebi:6 gst:6 brokerage:2 cost:6", f"WITH {FILLS}, {_COST}\nSELECT * FROM cost")
add("A30_round_trip", lambda s, d: lg.round_trip(fills(s, d)), f"{_ID} round_trip:6 breakeven_spread:7",
    f"""WITH {FILLS}, {_COST}, o AS (SELECT *, 2 * (brokerage + exchange + sebi) * 118e-2 + val * ({_r['stt']} + {_r['stamp']}) AS round_trip FROM cost)
SELECT *, round_trip / (quantity * lot_size) AS breakeven_spread FROM o""")


def _sessions(s, d):
    """A year of a supplier's lines is one session."""
    f = fills(s, d)
    return f.withColumns({"ship": F.col("date"), "date": F.trunc("date", "YEAR").cast("date")})


_SORD = ["ship", *FILL_ORDER[1:]]
_A31 = f"""WITH RECURSIVE {FILLS}, {_COST},
sq AS (SELECT *, CAST(date_trunc('year', date) AS DATE) AS yr, row_number() OVER (PARTITION BY symbol, date_trunc('year', date) ORDER BY {_ORD}) AS i FROM cost),
f AS (SELECT symbol, yr, i, side, price, quantity, 0::BIGINT AS inv, 0::DOUBLE AS basis, NULL::DOUBLE AS pnl FROM sq WHERE FALSE
  UNION ALL SELECT symbol, yr, 0, '', 0::DOUBLE, 0, 0, 0::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT symbol, yr FROM sq) q),
r AS (SELECT symbol, yr, 0 AS i, 0::BIGINT AS inv, 0::DOUBLE AS basis, NULL::DOUBLE AS pnl FROM (SELECT DISTINCT symbol, yr FROM sq) q
  UNION ALL SELECT n.symbol, n.yr, CAST(n.i AS INTEGER),
    CASE WHEN n.side = 'BUY' THEN r.inv + n.quantity WHEN r.inv > 0 THEN r.inv - n.quantity ELSE r.inv END,
    CASE WHEN n.side = 'BUY' THEN r.basis + n.price * n.quantity WHEN r.inv > 0 THEN r.basis - r.basis / r.inv * n.quantity ELSE r.basis END,
    CASE WHEN n.side = 'SELL' AND r.inv > 0 THEN (n.price - r.basis / r.inv) * n.quantity * n.lot_size END
  FROM r JOIN sq n ON n.symbol = r.symbol AND n.yr = r.yr AND n.i = r.i + 1),
s1 AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, yr ORDER BY i) AS cum, row_number() OVER (PARTITION BY symbol, yr ORDER BY i) AS k FROM r WHERE pnl IS NOT NULL),
s2 AS (SELECT *, cum - max(cum) OVER (PARTITION BY symbol, yr ORDER BY i) AS dd FROM s1),
s3 AS (SELECT symbol, yr, sum(pnl) AS gross, min(dd) AS dd, avg(pnl) FILTER (k > 1) AS m, stddev_pop(pnl) FILTER (k > 1) AS sd,
  avg(CAST(pnl > 0 AS INTEGER)) FILTER (k > 1) AS wr FROM s2 GROUP BY 1, 2),
iv AS (SELECT symbol, yr, i, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol, yr ORDER BY i) AS inv FROM sq),
iv2 AS (SELECT symbol, yr, max(abs(inv)) AS max_inventory, arg_max(inv, i) AS final_inventory FROM iv GROUP BY 1, 2),
t AS (SELECT symbol, yr, count(*) AS total_fills, count(*) FILTER (side = 'BUY') AS buy_fills, count(*) FILTER (side = 'SELL') AS sell_fills, sum(cost) AS total_costs FROM sq GROUP BY 1, 2),
met AS (SELECT symbol, yr AS date, total_fills, buy_fills, sell_fills, coalesce(gross, 0) AS gross_pnl, total_costs, coalesce(gross, 0) - total_costs AS net_pnl,
  CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END AS sharpe, coalesce(dd, 0) AS max_drawdown, coalesce(wr, 0) AS win_rate, max_inventory, final_inventory
  FROM t LEFT JOIN s3 USING (symbol, yr) JOIN iv2 USING (symbol, yr))"""
_MET = ("symbol date:d total_fills:l buy_fills:l sell_fills:l gross_pnl:2 total_costs:4 net_pnl:2 sharpe:5 max_drawdown:2 win_rate:6 "
        "max_inventory:l final_inventory:l")
add("A31_session_metrics", lambda s, d: lg.session_metrics(_sessions(s, d), _SORD), _MET, f"{_A31}\nSELECT * FROM met")


def _ledger(s, d):
    return lg.position_ledger(fills(s, d), FILL_ORDER)


_A32 = f"""WITH RECURSIVE {FILLS}, sq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_ORD}) AS i,
  CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS q FROM fills),
r AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS lots, 0::DOUBLE AS avg_price, 0::DOUBLE AS pnl FROM (SELECT DISTINCT symbol FROM sq) z
  UNION ALL SELECT n.symbol, n.i, r.lots + n.q,
    CASE WHEN r.lots * n.q >= 0 THEN (r.avg_price * abs(r.lots) + n.price * abs(n.q)) / abs(r.lots + n.q)
      WHEN abs(n.q) > abs(r.lots) THEN n.price WHEN r.lots + n.q = 0 THEN 0 ELSE r.avg_price END,
    CASE WHEN r.lots * n.q < 0 THEN (n.price - r.avg_price) * least(abs(n.q), abs(r.lots)) * n.lot_size * sign(r.lots) ELSE 0 END
  FROM r JOIN sq n ON n.symbol = r.symbol AND n.i = r.i + 1),
led AS (SELECT sq.*, r.lots, r.avg_price, r.pnl, sum(r.pnl) OVER (PARTITION BY r.symbol ORDER BY r.i) AS realized_pnl FROM r JOIN sq USING (symbol, i)),
ddn AS (SELECT *, max(realized_pnl) OVER (PARTITION BY symbol ORDER BY i) AS peak FROM led)"""
add("A32_position_ledger", _ledger, f"{_ID} lots:l avg_price:5 pnl:3 realized_pnl:2", f"{_A32}\nSELECT * FROM led")
add("A32_mark_to_market", lambda s, d: lg.mark_to_market(_ledger(s, d)),
    "symbol lots:l avg_price:5 realized_pnl:2 unrealized_pnl:3 total_pnl:2",
    f"""{_A32}, z AS (SELECT *, (price - avg_price) * lots * lot_size AS unrealized_pnl FROM led QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1)
SELECT *, realized_pnl + unrealized_pnl AS total_pnl FROM z""")
add("W31_drawdown", lambda s, d: lg.drawdown(stage(_ledger(s, d), "ledger")), f"{_ID} peak:2 drawdown:2",
    f"{_A32}\nSELECT *, realized_pnl - peak AS drawdown FROM ddn")
add("W32_inventory_path", lambda s, d: lg.inventory_path(fills(s, d), FILL_ORDER), f"{_ID} inventory:l max_inventory:l",
    f"""WITH {FILLS}, p AS (SELECT *, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS inventory FROM fills)
SELECT *, max(abs(inventory)) OVER (PARTITION BY symbol ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS max_inventory FROM p""")


add("C30_post_trade_report", lambda s, d: rp.post_trade_report(_sessions(s, d), _SORD), f"{_MET} stt:6 gst:6 turnover:3",
    f"""{_A31}, cc AS (SELECT symbol, yr AS date, sum(stt) AS stt, sum(gst) AS gst, sum(val) AS turnover FROM sq GROUP BY 1, 2)
SELECT * FROM met JOIN cc USING (symbol, date)""")


def _ofills(s, d):
    t = option_ticks(s, d)
    sec = F.floor(F.col("ts_local_ns") / 1_000_000_000).cast("long")
    return t.select(
        F.regexp_extract("symbol", "^([A-Z]+)", 1).alias("underlying"), "symbol", ist_date(sec).alias("date"), sec.alias("ts_sec"),
        F.when(F.col("tick_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("last_qty").alias("lots"))


def _deltas(s, d):
    m = 0.5 + 2 * F.col("moneyness")
    call = F.least(F.greatest(m, F.lit(0.0)), F.lit(1.0))
    return _priced(s, d).withColumn("delta", F.when(F.col("opt_type") == "CE", call).otherwise(call - 1)).select(
        "underlying", "symbol", "date", "ts_sec", "delta")


add("A33_net_option_delta", lambda s, d: lg.net_delta(_ofills(s, d), _deltas(s, d), 50, 100.0, 10),
    "underlying date:d ts_sec:l net_delta:4 hedge_lots:l hedge_side",
    f"""{_JOIN}, dl AS (SELECT underlying, symbol, date, ts_sec, least(greatest(5e-1 + 2 * moneyness, 0), 1) - CASE opt_type WHEN 'CE' THEN 0 ELSE 1 END AS delta FROM ch),
fl AS (SELECT regexp_extract(symbol, '^([A-Z]+)', 1) AS underlying, symbol, DATE '1970-01-01' + CAST((ts_local_ns // 1000000000 + 19800) // 86400 AS INTEGER) AS date,
  ts_local_ns // 1000000000 AS ts_sec, CASE tick_id % 2 WHEN 0 THEN last_qty ELSE -last_qty END AS dl FROM ticks),
ev0 AS (SELECT underlying, symbol, date, ts_sec, dl, NULL::DOUBLE AS delta FROM fl UNION ALL SELECT underlying, symbol, date, ts_sec, 0, delta FROM dl),
ev AS (SELECT underlying, symbol, date, ts_sec, sum(dl) AS dl, max(delta) AS delta FROM ev0 GROUP BY 1, 2, 3, 4),
hd AS (SELECT *, sum(dl) OVER w * coalesce(last_value(delta IGNORE NULLS) OVER w, 0) * 50 AS c FROM ev
  WINDOW w AS (PARTITION BY symbol, date ORDER BY ts_sec ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT underlying, date, ts_sec, c - lag(c, 1, 0) OVER (PARTITION BY symbol, date ORDER BY ts_sec) AS dc FROM hd),
u AS (SELECT underlying, date, ts_sec, sum(dc) AS dc FROM dd GROUP BY 1, 2, 3),
n AS (SELECT *, sum(dc) OVER (PARTITION BY underlying, date ORDER BY ts_sec ROWS UNBOUNDED PRECEDING) AS net_delta FROM u),
h AS (SELECT *, least(floor(abs(net_delta) / 50 + 1e-9), 10) AS lots FROM n)
SELECT *, CASE WHEN abs(net_delta) > 100 AND lots > 0 THEN lots ELSE 0 END AS hedge_lots,
  CASE WHEN abs(net_delta) > 100 AND lots > 0 THEN CASE WHEN net_delta > 0 THEN 'SELL' ELSE 'BUY' END END AS hedge_side FROM h""")
