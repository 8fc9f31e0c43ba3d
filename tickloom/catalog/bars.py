"""Bars and their rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import (
    BAR, BARS, FEATS, FEATS_DAY, TICKS, bars, bars_cte, feats, ticks,
)
from tickloom.functions import columns as fc
from tickloom.operators import bars as ob
from tickloom.operators import features as ft

KEY = "symbol ts_sec"
_LAD = " ".join(f"{c}:6" if "_p" in c else f"{c}:l" for c in ob.LADDER)
_BAR_COLS = (
    f"{KEY} open:6 high:6 low:6 close:6 volume_delta:l volume_cumulative:l tick_count:l vwap:6 oi:l "
    "spread_mean:7 spread_max:6 spread_bps:5 imbalance_mean:7 imbalance_std:6 imbalance_last:7 "
    f"total_bid_qty:l total_ask_qty:l weighted_mid:6 price_impact:7 {_LAD}")

add("A1_bars", bars, _BAR_COLS, f"{BARS}\nSELECT * FROM bars")
add("C1_build_bars", lambda s, d: ob.build_bars(ticks(s, d), 3600), f"{_BAR_COLS} date:d ist_tod:l",
    f"WITH {TICKS},\n{bars_cte(3600)}\nSELECT * FROM bars")
add("A2_simple_bars", bars, f"{KEY} open:6 high:6 low:6 close:6 volume:l tick_count:l vwap:6 oi:l",
    f"{BARS}\nSELECT *, volume_cumulative AS volume FROM bars")
add("J1_bars_with_micro",
    lambda s, d: ob.filled_tick_columns(ticks(s, d), BAR).groupBy("symbol", "ts_sec")
    .agg(*ob.bar_aggregates("tick_id", ladder=False)).select("symbol", "ts_sec", *ob.bar_columns(ladder=False)),
    f"{KEY} open:6 close:6 volume:l tick_count:l spread_bps:5 weighted_mid:6 imbalance_std:6",
    f"""{BARS}, f AS (SELECT symbol, ts_sec, avg(coalesce(spread_bps, 0)) AS sb, stddev(book_imbalance) AS isd,
      last(coalesce(weighted_mid, mid_price) ORDER BY ts_local_ns, tick_id) AS wm FROM raw GROUP BY ALL)
SELECT b.symbol, b.ts_sec, b.open, b.close, b.volume_cumulative AS volume, b.tick_count, f.sb AS spread_bps,
  f.wm AS weighted_mid, f.isd AS imbalance_std FROM bars b LEFT JOIN f USING (symbol, ts_sec)""")

add("P1_session_filter", lambda s, d: bars(s, d).where(fc.in_session()), f"{KEY} close:6 ist_tod:l",
    f"{BARS}\nSELECT * FROM bars WHERE ist_tod BETWEEN 33300 AND 55800")
add("P2_valid_price", lambda s, d: ticks(s, d).where("last_price > 0"), "tick_id symbol last_price:6",
    f"WITH {TICKS}\nSELECT * FROM ticks WHERE last_price > 0")
add("P3_tick_columns", lambda s, d: ob.tick_columns(ticks(s, d)),
    "tick_id ts_sec:l weighted_mid:6 price_impact:6 spread_bps:5",
    f"WITH {TICKS}, {bars_cte(1)}\nSELECT * FROM raw")
add("P5_display_time", bars, f"{KEY} ts_ist",
    f"{BARS}\nSELECT *, strftime(make_timestamp((ts_sec + 19800) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts_ist FROM bars")
add("P6_time_of_day", lambda s, d: fc.time_of_day(bars(s, d)),
    f"{KEY} ist_tod_sec:l ist_hhmm bucket_15m bucket_30m session",
    f"""{BARS}
SELECT symbol, ts_sec, ist_tod AS ist_tod_sec,
  printf('%02d:%02d', ist_tod // 3600, ist_tod % 3600 // 60) AS ist_hhmm,
  printf('%02d:%02d', ist_tod // 3600, ist_tod % 3600 // 900 * 15) AS bucket_15m,
  printf('%02d:%02d', ist_tod // 3600, ist_tod % 3600 // 1800 * 30) AS bucket_30m,
  CASE WHEN ist_tod < 35100 THEN 'open' WHEN ist_tod >= 53100 THEN 'close' ELSE 'midday' END AS session FROM bars""")

_VOL = "realized_vol_10s:5 realized_vol_30s:5 realized_vol_60s:5 realized_vol_300s:5"
_IMB = "imbalance_ma_10s:7 imbalance_ma_30s:7 imbalance_ma_60s:7"
_MOM = "price_mom_10s:6 price_mom_30s:6 price_mom_60s:6"


def _day(s, d):
    return feats(s, d, cross_day=False)


add("W1_rolling_volatility", feats, f"{KEY} {_VOL}", f"{FEATS}\nSELECT * FROM feats")
add("W2_imbalance_means", feats, f"{KEY} {_IMB}", f"{FEATS}\nSELECT * FROM feats")
add("W3_spread_zscore", feats, f"{KEY} spread_zscore:5", f"{FEATS}\nSELECT * FROM feats")
add("W4_volume_ratio", feats, f"{KEY} volume_ratio:6", f"{FEATS}\nSELECT * FROM feats")
add("W5_momentum", feats, f"{KEY} {_MOM}", f"{FEATS}\nSELECT * FROM feats")
add("C2_bar_features", _day,
    f"{_BAR_COLS} {_VOL} {_IMB} spread_zscore:5 volume_ratio:6 {_MOM}", f"{FEATS_DAY}\nSELECT * FROM feats")


def _full(fn, x, n, part="symbol"):
    w = f"(PARTITION BY {part} ORDER BY ts_sec ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {fn}({x}) OVER {w} END"


_W6 = ", ".join([f"{_full('stddev', 'ret', n)} * sqrt({n}) AS realized_vol_{n}s" for n in (10, 30, 60, 300)]
                + [f"{_full('avg', 'imbalance_last', n)} AS imbalance_ma_{n}s" for n in (10, 30, 60)]
                + [f"close / lag(close, {n}) OVER (PARTITION BY symbol ORDER BY ts_sec) - 1 AS price_mom_{n}s"
                   for n in (10, 30, 60)]
                + [f"coalesce(tick_count / {_full('avg', 'tick_count', 60)}, 1) AS volume_ratio"])
add("W6_return_volatility", lambda s, d: ft.bar_features(bars(s, d), "returns", cross_day=True),
    f"{KEY} {_VOL} {_IMB} {_MOM} volume_ratio:6",
    f"""{BARS}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_sec) - 1 AS ret FROM bars)
SELECT symbol, ts_sec, {_W6} FROM r""")

add("O1_sorted_bars", lambda s, d: bars(s, d).orderBy("ts_sec", "symbol"), f"{KEY} close:6",
    f"{BARS}\nSELECT * FROM bars ORDER BY ts_sec, symbol")
add("U6_distinct_timestamps",
    lambda s, d: ob.distinct_timestamps(ob.tick_columns(ticks(s, d), BAR), "tick_id"),
    f"{KEY} tick_id last_price:6",
    f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_sec ORDER BY tick_id) AS rn FROM raw)
SELECT * FROM r WHERE rn = 1""")
add("C16_resample", lambda s, d: ob.resample_last(bars(s, d, 600), 3600), f"{KEY} close:6",
    f"""WITH {TICKS}, {bars_cte(600)}
SELECT symbol, ts_sec // 3600 * 3600 AS ts_sec, last(close ORDER BY ts_sec) AS close
FROM bars GROUP BY symbol, ts_sec // 3600 * 3600""")
