"""Streaming jobs, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.data import _nested
from tickloom.catalog.flow import KEY
from tickloom.catalog.intel import _history
from tickloom.catalog.standin import BARS, FEATS_DAY, TICKS, table, ticks_of
from tickloom.session import scratch_path
from tickloom.sources import replay as rc
from tickloom.sources import ticks as tk
from tickloom.streaming import corrections as sc
from tickloom.streaming import jobs as sj
from tickloom.streaming import state as ss


def _events(s, d):
    return sj.file_stream(s, d, table(s, d, "events").schema, "events.parquet")


def _stream(s, d):
    return ticks_of(_events(s, d))


def _run(s, df, name, mode="append"):
    path = scratch_path(s, name)
    sj.drain(sj.store(df, path, sj.checkpoint_for(s, name), mode=mode))
    return s.read.schema(df.schema).parquet(path)


def _ingested(s, d):
    path = scratch_path(s, "ticks")
    sj.drain(sj.ingest(_stream(s, d), path, sj.checkpoint_for(s, "ticks"), every=None))
    return s.read.parquet(path)


def _ingested_nested(s, d):
    path = scratch_path(s, "flat")
    sj.drain(sj.ingest(tk.flatten_depth(_nested_of(_stream(s, d))), path, sj.checkpoint_for(s, "flat"), every=None))
    return s.read.parquet(path)


def _nested_of(t):
    return _nested(None, None, t)


_CLOSED = f"""{BARS}, closed AS (SELECT bars.* FROM bars WHERE ts_sec + 1800 <= (SELECT max(ts_local_ns) / 1e9 - 5 FROM ticks))"""
add("T1_tick_ingest", _ingested_nested, "ts_local_ns symbol date:d mid_price:3 bid_q1:l ask_q5:l bid_o5:l",
    f"""WITH {TICKS}
SELECT ts_local_ns, symbol, DATE '1970-01-01' + CAST((ts_local_ns // 1000000000 + 19800) // 86400 AS INTEGER) AS date,
  CASE WHEN tick_id % 7 >= 1 THEN round((bid_p1 + ask_p1) / 2 + 1e-9, 2) ELSE 0 END AS mid_price, CASE WHEN tick_id % 7 >= 1 THEN bid_q1 ELSE 0 END AS bid_q1,
  CASE WHEN tick_id % 7 >= 5 THEN ask_q5 ELSE 0 END AS ask_q5, CASE WHEN tick_id % 7 >= 5 THEN 5 ELSE 0 END AS bid_o5 FROM ticks""")
def _recorded(s, d):
    """The ticks as broker messages: odd ones in the text format, every 97th broken, replayed in two starts of a query."""
    nested = _nested_of(ticks_of(table(s, d, "events"))).withColumn("seq", F.expr("ts_local_ns div 1000 % 1000"))
    rest = [c for c in nested.columns if c not in ("ts_local_ns", "seq")]
    flat = ticks_of(table(s, d, "events"))
    text = F.struct("symbol", F.col("last_price").cast("string").alias("lp"), F.col("volume").cast("string").alias("v"), *[
        F.col(f"{side}_{k}{i}").cast("string").alias(f"{short}{k}{i}")
        for i in range(1, 6) for side, short in (("bid", "b"), ("ask", "s")) for k in "pq"])
    depth = nested.where("seq % 2 = 0").select(F.lit("depth").alias("feed"), "ts_local_ns", F.to_json(F.struct(*rest)).alias("body"), "seq")
    lines = flat.withColumn("seq", F.expr("ts_local_ns div 1000 % 1000")).where("seq % 2 = 1").select(
        F.lit("text").alias("feed"), "ts_local_ns", F.to_json(text).alias("body"), "seq")
    both = depth.unionByName(lines).withColumn("body", F.when(F.col("seq") % 97 == 0, F.substring("body", 2, 30)).otherwise(F.col("body")))
    src, out, mark = scratch_path(s, "recording"), scratch_path(s, "replayed"), sj.checkpoint_for(s, "replayed")
    for part in (both.where("seq < 400"), both.where("seq >= 400")):
        rc.record(part, src)
        sj.drain(rc.ingest_recording(rc.replay(s, src, 5000), out, mark))
    return out


def _replayed(s, d):
    out = _recorded(s, d)
    ticks = s.read.parquet(f"{out}/ticks").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("last_price").alias("price"), F.sum("bid_q1").alias("bid_q1"), F.sum("ask_p1").alias("ask_p1"),
        F.sum("bid_o5").alias("bid_o5"), F.min("ts_local_ns").alias("first"), F.countDistinct("batch").alias("batches"))
    return ticks.unionByName(s.read.parquet(f"{out}/rejects").agg(
        F.lit("rejects").alias("symbol"), F.count(F.lit(1)).alias("n"), F.min("ts_local_ns").alias("first"),
        F.countDistinct("batch").alias("batches")), allowMissingColumns=True)


add("T1_replayed_messages", _replayed, "symbol n:l price:3 bid_q1:l ask_p1:3 bid_o5:l first:l batches:l",
    f"""WITH {TICKS}, q AS (SELECT *, (ts_local_ns // 1000) % 1000 AS seq, tick_id % 7 AS k7 FROM ticks),
g AS (SELECT symbol, count(*) AS n, sum(last_price) AS price, sum(CASE WHEN seq % 2 = 1 OR k7 >= 1 THEN bid_q1 ELSE 0 END) AS bid_q1,
  sum(CASE WHEN seq % 2 = 1 OR k7 >= 1 THEN ask_p1 ELSE 0 END) AS ask_p1, sum(CASE WHEN seq % 2 = 1 THEN NULL WHEN k7 >= 5 THEN 5 ELSE 0 END) AS bid_o5,
  min(ts_local_ns) AS first, count(DISTINCT seq < 400) AS batches FROM q WHERE seq % 97 <> 0 GROUP BY 1)
SELECT * FROM g UNION ALL SELECT 'rejects', count(*), NULL, NULL, NULL, NULL, min(ts_local_ns), count(DISTINCT seq < 400) FROM q WHERE seq % 97 = 0""")
add("S10_flush_sink", lambda s, d: _ingested(s, d).groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n_ticks")), "date:d symbol n_ticks:l",
    f"""WITH {TICKS}
SELECT DATE '1970-01-01' + CAST((ts_local_ns // 1000000000 + 19800) // 86400 AS INTEGER) AS date, symbol, count(*) AS n_ticks FROM ticks GROUP BY 1, 2""")


def _bars(s, d):
    return _run(s, sj.bar_stream(_stream(s, d), 1800), "bars")


def _all_bars(s, d):
    emitted = _bars(s, d)
    return emitted.unionByName(sj.closing_bars(ticks_of(table(s, d, "events")), emitted, 1800))


add("T2_bar_stream", _all_bars, f"{KEY} open:6 high:6 low:6 close:6 volume_delta:l tick_count:l spread_mean:7 imbalance_std:6 weighted_mid:6 bid_q5:l",
    f"{BARS}\nSELECT * FROM bars")


def _features(s, d):
    return _run(s, ss.rolling_features(sj.bar_stream(_stream(s, d), 1800)), "features")


_FS = FEATS_DAY.replace("FROM bars)", "FROM closed)").replace(",\nfeats AS", ", closed AS (SELECT bars.* FROM bars WHERE ts_sec + 1800 <= (SELECT max(ts_local_ns) / 1e9 - 5 FROM ticks)),\nfeats AS")
add("T3_rolling_feature_stream", _features,
    f"{KEY} realized_vol_10s:5 realized_vol_30s:5 realized_vol_60s:5 realized_vol_300s:5 imbalance_ma_10s:6 imbalance_ma_30s:6 imbalance_ma_60s:6 "
    "price_mom_10s:6 price_mom_30s:6 price_mom_60s:6 spread_zscore:4 volume_ratio:6", f"{_FS}\nSELECT * FROM feats")
add("T5_sigma_buffer", _features, f"{KEY} sigma:5",
    f"""{_FS}, v AS (SELECT symbol, ts_sec, realized_vol_60s AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts_sec) AS k FROM feats WHERE realized_vol_60s > 0),
s AS (SELECT symbol, ts_sec, CASE WHEN k >= 30 THEN avg(v) OVER (PARTITION BY symbol ORDER BY ts_sec ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) ELSE v END AS s FROM v)
SELECT f.symbol, f.ts_sec, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY f.symbol ORDER BY f.ts_sec ROWS UNBOUNDED PRECEDING), 2) AS sigma
FROM feats f LEFT JOIN s USING (symbol, ts_sec)""")


def _corrected(s, d, features=True):
    """The events in four files that each hold ticks of all times, read one a batch: most ticks come late."""
    src, out = scratch_path(s, "mixed"), scratch_path(s, "corrected")
    e = table(s, d, "events")
    e.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(src)
    feed = ticks_of(sj.file_stream(s, src, e.schema, files_per_batch=1))
    sj.drain(sc.corrected_stream(feed, out, sj.checkpoint_for(s, "corrected"), 1800, features=features))
    return out


_BAR_COLS = f"{KEY} open:6 high:6 low:6 close:6 volume_delta:l tick_count:l spread_mean:7 imbalance_std:6 weighted_mid:6 bid_q5:l"
add("T2_corrected_bars", lambda s, d: sc.latest(s, _corrected(s, d, False), "bars"), _BAR_COLS, f"{BARS}\nSELECT * FROM bars")
add("T3_corrected_features", lambda s, d: sc.latest(s, _corrected(s, d), "features"),
    f"{KEY} realized_vol_10s:5 realized_vol_30s:5 realized_vol_60s:5 realized_vol_300s:5 imbalance_ma_10s:6 imbalance_ma_30s:6 imbalance_ma_60s:6 "
    "price_mom_10s:6 price_mom_30s:6 price_mom_60s:6 spread_zscore:4 volume_ratio:6", f"{FEATS_DAY}\nSELECT * FROM feats")


def _late(s, d):
    """Purchases and errors arrive in a second file, after the others."""
    src, out = scratch_path(s, "feed"), scratch_path(s, "split")
    e = table(s, d, "events")
    second = "event_type IN ('purchase', 'error')"
    e.where(f"NOT {second}").write.parquet(src)
    q = lambda: sj.drain(sj.split_late(ticks_of(sj.file_stream(s, src, e.schema)), out, checkpoint, 86400.0))
    checkpoint = sj.checkpoint_for(s, "late")
    q()
    e.where(second).write.mode("append").parquet(src)
    q()
    return s.read.parquet(f"{out}/ticks").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.sum(F.col("is_late").cast("int")).alias("n_late"))


add("T4_late_ticks", _late, "symbol n_ticks:l n_late:l",
    f"""WITH {TICKS}, m AS (SELECT max(ts_local_ns) - 86400000000000 AS lim FROM ticks WHERE symbol NOT IN ('purchase', 'error'))
SELECT symbol, count(*) AS n_ticks, count(*) FILTER (symbol IN ('purchase', 'error') AND ts_local_ns < lim) AS n_late FROM ticks, m GROUP BY 1""")


def _strikes(s, d):
    out = scratch_path(s, "strikes")
    e = _events(s, d).select(F.upper("event_type").alias("underlying"), F.col("ts").cast("timestamp").alias("ts"), (25 + F.col("value") / 50).alias("spot_price"))
    master = table(s, d, "events").select(F.upper("event_type").alias("underlying"), (20 + 5 * (F.col("user_id") % 5)).cast("double").alias("strike")).distinct()
    sj.drain(sj.strike_stream(e, master, out, sj.checkpoint_for(s, "strikes"), 1.0, 5))
    c = s.read.parquet(f"{out}/changes")
    return c.withColumns({x: F.concat_ws(",", F.transform(x, lambda v: v.cast("int").cast("string"))) for x in ("to_add", "to_remove")})


add("T6_strike_stream", _strikes, "underlying slot:l atm:2 to_add to_remove",
    """WITH RECURSIVE e AS (SELECT upper(event_type) AS underlying, epoch_us(ts) AS us, 25 + value / 50 AS px FROM events),
sl0 AS (SELECT underlying, us // 1800000000 * 1800 AS slot, last(px ORDER BY us, px) AS price FROM e GROUP BY 1, 2),
sl AS (SELECT underlying, slot, round_even(price, 0) AS atm, DATE '1970-01-01' + CAST((slot + 19800) // 86400 AS INTEGER) AS date,
  row_number() OVER (PARTITION BY underlying, (slot + 19800) // 86400 ORDER BY slot) AS i FROM sl0 WHERE slot + 1800 <= (SELECT max(us) / 1e6 - 5 FROM e)),
fo AS (SELECT underlying, date, slot, atm, i, atm AS cur, TRUE AS chg FROM sl WHERE i = 1 UNION ALL
  SELECT n.underlying, n.date, n.slot, n.atm, n.i, CASE WHEN abs(n.atm - f.cur) >= 2 THEN n.atm ELSE f.cur END, abs(n.atm - f.cur) >= 2
  FROM fo f JOIN sl n ON n.underlying = f.underlying AND n.date = f.date AND n.i = f.i + 1),
ka AS (SELECT underlying, date, slot, atm, lag(atm) OVER (PARTITION BY underlying, date ORDER BY slot) AS old_atm FROM fo WHERE chg),
kl AS (SELECT DISTINCT upper(event_type) AS underlying, 20 + 5 * (user_id % 5) AS strike FROM events)
SELECT ka.underlying, slot, atm, coalesce(string_agg(CAST(strike AS VARCHAR), ',' ORDER BY strike) FILTER (abs(strike - atm) <= 5 AND NOT coalesce(abs(strike - old_atm) <= 5, FALSE)), '') AS to_add,
  coalesce(string_agg(CAST(strike AS VARCHAR), ',' ORDER BY strike) FILTER (abs(strike - old_atm) <= 5 AND NOT abs(strike - atm) <= 5), '') AS to_remove
FROM ka JOIN kl USING (underlying) GROUP BY 1, 2, 3""")


def _ttl(s, d):
    o = sj.file_stream(s, d, table(s, d, "orders").schema, "orders.parquet")
    return ss.current(_run(s, ss.living_signals(_history(s, d, o)), "signals"))


add("T7_signal_ttl", _ttl, "symbol mm_action widen_factor:9 is_default:b",
    """WITH h AS (SELECT 'C' || o_custkey AS symbol, o_orderdate + to_minutes(o_orderkey % 1440) AS g, CASE o_orderpriority WHEN '5-LOW' THEN 'WIDEN' ELSE 'PAUSE' END AS a, 1 + o_totalprice / 1000000 AS f FROM orders),
l AS (SELECT *, g + INTERVAL 30 DAY < (SELECT max(g) FROM h) - INTERVAL 1 MINUTE AS x FROM h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY g DESC) = 1)
SELECT symbol, CASE WHEN x THEN 'NORMAL' ELSE a END AS mm_action, CASE WHEN x THEN 1 ELSE f END AS widen_factor, x AS is_default FROM l""")


def _fresh(s, d):
    out = scratch_path(s, "fresh")
    t = _stream(s, d).withColumn("symbol", F.when(F.col("symbol") == "view", "VIEW24JANFUT").when(F.col("symbol") == "click", "CLICK_SPOT").when(
        F.col("symbol") == "error", "USDINR24JANFUT").when(F.col("symbol") == "signup", "X24JAN100CE").otherwise("X24JAN100PE"))
    sj.drain(sj.freshness_stream(t, out, sj.checkpoint_for(s, "fresh")))
    return sj.freshness(s, out, F.lit("2024-02-01").cast("timestamp"))


add("T8_feed_freshness", _fresh, "class n_ticks:l age_seconds:3",
    """WITH c AS (SELECT CASE event_type WHEN 'view' THEN 'FUT' WHEN 'click' THEN 'SPOT' WHEN 'error' THEN 'CURRENCY' WHEN 'signup' THEN 'CE' ELSE 'PE' END AS class, ts FROM events)
SELECT class, count(*) AS n_ticks, (epoch_us(TIMESTAMP '2024-02-01') - max(epoch_us(ts))) / 1e6 AS age_seconds FROM c GROUP BY 1""")
