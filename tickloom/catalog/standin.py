"""How the given tables stand in for market data, in Spark and in DuckDB SQL.

One list of expressions, valid in both dialects, defines each stand-in, so the
query and the SQL that checks it start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import build_bars
from tickloom.operators.features import bar_features

BAR = 1800


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_Q = {}
for _i in range(1, 6):
    _Q[f"bid_p{_i}"] = f"mid_price - spread / 2 - 5e-2 * {_i - 1}"
    _Q[f"ask_p{_i}"] = f"mid_price + spread / 2 + 5e-2 * {_i - 1}"
    _Q[f"bid_q{_i}"] = f"CAST({10 * _i} + (k * {_i + 2}) % 50 AS BIGINT)"
    _Q[f"ask_q{_i}"] = f"CAST({10 * _i} + (k * {_i + 5}) % 47 AS BIGINT)"

_STEP1 = {
    "tick_id": "event_id", "symbol": "event_type", "instrument_token": "CAST(user_id AS VARCHAR(20))",
    "last_price": "value", "last_qty": "CAST(1 + k % 10 AS BIGINT)", "avg_price": "value + 25e-2",
    "volume": "event_id * 10 + k % 10", "oi": "CAST(1000 + (k * 37) % 101 AS BIGINT)",
    "mid_price": "value + 1e-2 * (k % 7)", "spread": "5e-2 * (1 + k % 5)", "k": "k", "ts_local_ns": "ts_local_ns",
}
_STEP3 = {
    "total_bid_qty": "bid_q1 + bid_q2 + bid_q3 + bid_q4 + bid_q5",
    "total_ask_qty": "ask_q1 + ask_q2 + ask_q3 + ask_q4 + ask_q5",
}
_STEP4 = {"book_imbalance": "CAST(total_bid_qty - total_ask_qty AS DOUBLE) / (total_bid_qty + total_ask_qty)"}


def _sel(m: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in m.items()]


def ticks_of(events: DataFrame) -> DataFrame:
    """events (batch or stream) as ticks: event_type is the symbol, value the price, props.k the book."""
    e = events.select(
        "event_id", "event_type", "user_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_local_ns"))
    return (
        e.selectExpr(*_sel(_STEP1)).selectExpr("*", *_sel(_Q))
        .selectExpr("*", *_sel(_STEP3)).selectExpr("*", *_sel(_STEP4)).drop("k")
    )


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return ticks_of(table(spark, d, "events"))


def bars(spark: SparkSession, d: str, width: int = BAR) -> DataFrame:
    return build_bars(ticks(spark, d), width)


def feats(spark: SparkSession, d: str, cross_day: bool = True) -> DataFrame:
    return bar_features(bars(spark, d), cross_day=cross_day)


# ---- the same stand-ins as SQL ---------------------------------------------

TICKS = f"""t0 AS (
  SELECT event_id, event_type, user_id, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         epoch_us(ts) * 1000 AS ts_local_ns FROM events),
t1 AS (SELECT {', '.join(_sel(_STEP1))} FROM t0),
t2 AS (SELECT *, {', '.join(_sel(_Q))} FROM t1),
t3 AS (SELECT *, {', '.join(_sel(_STEP3))} FROM t2),
ticks AS (SELECT *, {', '.join(_sel(_STEP4))} FROM t3)"""

_LADDER = [f"{s}_{k}{i}" for s in ("bid", "ask") for i in range(1, 6) for k in ("p", "q")]


def bars_cte(width: int = BAR, name: str = "bars") -> str:
    lasts = ", ".join(f"last({c} ORDER BY ts_local_ns, tick_id) AS {c}"
                      for c in ["oi", "total_bid_qty", "total_ask_qty", "weighted_mid", *_LADDER])
    return f"""raw AS (
  SELECT *, (ts_local_ns // 1000000000) // {width} * {width} AS ts_sec,
         (bid_p1 * ask_q1 + ask_p1 * bid_q1) / nullif(bid_q1 + ask_q1, 0) AS weighted_mid,
         abs(last_price - mid_price) AS price_impact,
         spread / nullif(mid_price, 0) * 10000 AS spread_bps
  FROM ticks WHERE last_price > 0),
{name} AS (
  SELECT symbol, ts_sec, first(last_price ORDER BY ts_local_ns, tick_id) AS open,
         max(last_price) AS high, min(last_price) AS low,
         last(last_price ORDER BY ts_local_ns, tick_id) AS close,
         last(volume ORDER BY ts_local_ns, tick_id) - first(volume ORDER BY ts_local_ns, tick_id) AS volume_delta,
         last(volume ORDER BY ts_local_ns, tick_id) AS volume_cumulative,
         count(*) AS tick_count, last(avg_price ORDER BY ts_local_ns, tick_id) AS vwap,
         avg(spread) AS spread_mean, max(spread) AS spread_max, avg(spread_bps) AS spread_bps,
         avg(book_imbalance) AS imbalance_mean, stddev(book_imbalance) AS imbalance_std,
         last(book_imbalance ORDER BY ts_local_ns, tick_id) AS imbalance_last,
         avg(price_impact) AS price_impact, {lasts},
         (ts_sec + 19800) % 86400 AS ist_tod,
         DATE '1970-01-01' + CAST((ts_sec + 19800) // 86400 AS INTEGER) AS date
  FROM raw GROUP BY symbol, ts_sec)"""


def feats_cte(part: str = "symbol", src: str = "bars", name: str = "feats") -> str:
    def w(n):
        return f"(PARTITION BY {part} ORDER BY ts_sec ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    line = f"(PARTITION BY {part} ORDER BY ts_sec)"
    cols = [f"stddev(close) OVER {w(n)} AS realized_vol_{n}s" for n in (10, 30, 60, 300)]
    cols += [f"avg(imbalance_last) OVER {w(n)} AS imbalance_ma_{n}s" for n in (10, 30, 60)]
    cols += [f"(close - lag(close, {n}) OVER {line}) / nullif(lag(close, {n}) OVER {line}, 0) AS price_mom_{n}s"
             for n in (10, 30, 60)]
    cols.append(f"(spread_mean - avg(spread_mean) OVER {w(300)}) / "
                f"CASE WHEN stddev(spread_mean) OVER {w(300)} > 1e-12 THEN stddev(spread_mean) OVER {w(300)} END AS spread_zscore")
    cols.append(f"tick_count / nullif(avg(tick_count) OVER {w(60)}, 0) AS volume_ratio")
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {src})"


BARS = f"WITH {TICKS},\n{bars_cte()}"
FEATS = f"{BARS},\n{feats_cte()}"
FEATS_DAY = f"{BARS},\n{feats_cte('symbol, date')}"


# ---- instruments from part, stored files from events -------------------------

_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
_I1 = {
    "p_partkey": "p_partkey", "p_size": "p_size", "p_brand": "p_brand", "p_retailprice": "p_retailprice",
    "name": "upper(replace(p_name, ' ', ''))",
    "mon": f"substr('{_MONTHS}', CAST(1 + 3 * (p_partkey % 12) AS INTEGER), 3)",
    "yy": "CAST(25 + p_size % 2 AS VARCHAR(2))",
    "strike_txt": "CAST(CAST(50 * floor(p_retailprice / 50) AS BIGINT) AS VARCHAR(20))",
    "wk": "substr('123456789OND', CAST(1 + p_partkey % 12 AS INTEGER), 1)",
    "lot_size": "CAST(25 * (1 + p_size % 4) AS INTEGER)",
}
_I2 = {
    "p_partkey": "p_partkey", "p_size": "p_size", "p_brand": "p_brand", "p_retailprice": "p_retailprice",
    "name": "name", "lot_size": "lot_size",
    "symbol": "CASE p_size % 6 WHEN 0 THEN name || yy || mon || 'FUT' WHEN 1 THEN name || yy || mon || strike_txt || 'CE' "
              "WHEN 2 THEN name || yy || mon || strike_txt || 'PE' "
              "WHEN 3 THEN name || yy || wk || '0' || CAST(1 + p_size % 9 AS VARCHAR(2)) || strike_txt || 'CE' "
              "WHEN 4 THEN name || '_SPOT' ELSE 'USDINR' || yy || mon || 'FUT' END",
}


def instruments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_sel(_I1)).selectExpr(*_sel(_I2))


INSTRUMENTS = f"i1 AS (SELECT {', '.join(_sel(_I1))} FROM part), instruments AS (SELECT {', '.join(_sel(_I2))} FROM i1)"

_FILE = {
    "base": "upper(event_type)", "user_id": "user_id", "event_id": "event_id", "event_type": "event_type",
    "date": "CAST(ts AS DATE)",
    "contract": "upper(event_type) || '24' || CASE user_id % 3 WHEN 0 THEN 'MAR' WHEN 1 THEN 'JAN' ELSE 'FEB' END || 'FUT'",
    "layout": "CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'flat' END",
}


def stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*_sel(_FILE))


def files(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).groupBy("base", "contract", "layout", "date").agg(F.count(F.lit(1)).alias("n_files"))


STORED = f"stored AS (SELECT {', '.join(_sel(_FILE))} FROM events)"
FILES = f"{STORED}, files AS (SELECT base, contract, layout, date, count(*) AS n_files FROM stored GROUP BY ALL)"
# expiry of a contract month m in SQL: listed dates of 2026, else the last Thursday
LAST_THU = "(last_day({m}) - CAST((isodow(last_day({m})) + 3) % 7 AS INTEGER))"


# ---- options, spot and futures from events ------------------------------------

_STRIKE = "20 + 5 * (user_id % 5)"
_UNDER = "upper(event_type)"
_SPOT = "25 + value / 50"
_O1 = {
    **_STEP1,
    "symbol": f"{_UNDER} || '24FEB' || CAST({_STRIKE} AS VARCHAR(9)) || CASE k % 2 WHEN 0 THEN 'CE' ELSE 'PE' END",
    "last_price": f"greatest(0e0, CASE k % 2 WHEN 0 THEN {_SPOT} - ({_STRIKE}) ELSE ({_STRIKE}) - ({_SPOT}) END) + 3e-1 + 2e-2 * k",
    "mid_price": "value + 1e-2 * (k % 7)",
}
# on every fourth day there is no spot: its events are the near future's
_KIND = "CASE WHEN user_id % 3 = 0 AND dayofmonth(ts) % 4 = 0 THEN 1 ELSE user_id % 3 END"
_FEED = {
    **_STEP1,
    "symbol": f"{_UNDER} || CASE {_KIND} WHEN 0 THEN '_SPOT' WHEN 1 THEN '24FEBFUT' ELSE '24MARFUT' END",
    "last_price": _SPOT, "mid_price": _SPOT,
}


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "event_type", "user_id", "value", "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_local_ns"))


def _with_book(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *_sel(_Q)).selectExpr("*", *_sel(_STEP3)).selectExpr("*", *_sel(_STEP4)).drop("k")


def option_ticks(spark: SparkSession, d: str) -> DataFrame:
    return _with_book(_raw_events(spark, d).selectExpr(*_sel(_O1)))


def feed_bars(spark: SparkSession, d: str, width: int = BAR) -> tuple[DataFrame, DataFrame]:
    """(spot bars, future bars); every fourth day has no spot."""
    b = build_bars(_with_book(_raw_events(spark, d).selectExpr(*_sel(_FEED))), width, ladder=False)
    b = b.withColumn("underlying", F.regexp_extract("symbol", "^([A-Z]+)", 1))
    fut = b.where("symbol LIKE '%FUT'").withColumn(
        "expiry", F.when(F.col("symbol").like("%FEBFUT"), F.lit("2024-02-29")).otherwise(F.lit("2024-03-28")).cast("date"))
    return b.where("symbol LIKE '%SPOT'"), fut


OPTION_TICKS = TICKS.replace(", ".join(_sel(_STEP1)), ", ".join(_sel(_O1)))
OBARS = f"WITH {OPTION_TICKS},\n{bars_cte(name='obars')}"
FEED = f"""fe AS (SELECT *, {_KIND} AS kind, {_UNDER} AS underlying, {_SPOT} AS px, (ts_us // 1000000) // {BAR} * {BAR} AS ts_sec FROM (
  SELECT *, epoch_us(ts) AS ts_us FROM events) q),
fb AS (SELECT underlying, kind, ts_sec, last(px ORDER BY ts_us, event_id) AS close,
  DATE '1970-01-01' + CAST((ts_sec + 19800) // 86400 AS INTEGER) AS date FROM fe GROUP BY ALL),
near AS (SELECT underlying, date, min(kind) AS kind FROM fb WHERE kind > 0 GROUP BY 1, 2),
spot AS (SELECT underlying, date, ts_sec, close AS spot_price, 'spot' AS source FROM fb WHERE kind = 0 UNION ALL
  SELECT f.underlying, f.date, f.ts_sec, f.close, 'future' FROM fb f JOIN near USING (underlying, date, kind)
  WHERE NOT EXISTS (SELECT 1 FROM fb s WHERE s.kind = 0 AND s.underlying = f.underlying AND s.date = f.date))"""


# ---- fills from lineitem ----------------------------------------------------------
# The price factor keeps results off exact rounding ties, where two engines may differ.

_FILL = {
    "symbol": "CAST(l_suppkey AS VARCHAR(20))", "date": "CAST(l_shipdate AS DATE)",
    "side": "CASE l_linenumber % 2 WHEN 0 THEN 'SELL' ELSE 'BUY' END", "price": "l_extendedprice / l_quantity * 9876543210123e-13",
    "quantity": "CAST(l_quantity AS INTEGER)", "lot_size": "5",
    "instrument_type": "CASE l_returnflag WHEN 'A' THEN 'equity_options' WHEN 'R' THEN 'currency_options' "
                       "ELSE CASE l_linestatus WHEN 'F' THEN 'equity_futures' ELSE 'currency_futures' END END",
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_tax": "l_tax", "l_discount": "l_discount",
}
FILL_ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]
FILLS = f"fills AS (SELECT {', '.join(_sel(_FILL))} FROM lineitem)"


def fills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_sel(_FILL))


# ---- news from documents, events from orders ---------------------------------------

_DD = "lpad(CAST(1 + doc_id % 28 AS VARCHAR(2)), 2, '0')"
_NEWS = {
    "doc_id": "doc_id", "source": "CASE lang WHEN 'en' THEN 'NSE' WHEN 'fr' THEN 'BSE' ELSE source END", "headline": "text",
    "published": f"CASE doc_id % 3 WHEN 0 THEN {_DD} || '-Jan-2024' WHEN 1 THEN '2024-01-' || {_DD} "
                 f"ELSE 'Mon, ' || {_DD} || ' Jan 2024 10:00:00 +0530' END",
    "uncertainty": "(n_chars % 130) / 1e2", "sentiment": "(n_chars % 50) / 2e1 - 12e-1",
    "mm_action": "CASE n_chars % 4 WHEN 0 THEN 'PAUSE' WHEN 1 THEN 'WIDEN' WHEN 2 THEN 'NORMAL' ELSE 'HOLD' END",
    "widen_factor": "(n_chars % 13) / 2e0", "pause_minutes": "n_chars % 300",
    "informed_flow_risk": "CASE n_chars % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END",
    "event_type": "CASE n_chars % 2 WHEN 0 THEN 'macro' ELSE 'sector' END",
}
_FRAGMENTS = ("THER", "ONDER", "EANER", "IONEN", "ESTEN", "ANERE", "NDTHE", "OUTHE", "ZZQQ", "ERBLES", "QXQ", "THOUR")
_EVSYM = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FRAGMENTS)) + " END"
_PHRASES = ("Quarterly results Q1", "Interim Dividend", "Board Meeting called", "AGM notice", "Bonus issue", "Rights Issue",
            "Merger approved", "General update")
_EVENT = {
    "symbol": _EVSYM, "event_date": "CAST(o_orderdate AS DATE)",
    "description": "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PHRASES)) + " END",
    "source": "CASE o_orderstatus WHEN 'O' THEN 'BSE' ELSE 'NSE' END",
}


def news(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    scored = table(spark, d, "labels").select("doc_id").distinct().withColumn("scored", F.lit(True))
    return doc.selectExpr(*_sel(_NEWS)).join(scored, "doc_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


def universe(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    words = words.where(F.length("w") >= 8).select(F.upper("w").alias("symbol"))
    return words.unionByName(table(spark, d, "orders").selectExpr(f"{_EVSYM} AS symbol")).distinct()


def contracts(spark: SparkSession, d: str) -> DataFrame:
    return universe(spark, d).select(F.concat("symbol", F.lit("26MAYFUT")).alias("symbol"))


def events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "orders").selectExpr(*_sel(_EVENT))
    return e.where("source = 'NSE'"), e.where("source = 'BSE'")


NEWS = f"""news0 AS (SELECT {', '.join(_sel(_NEWS))} FROM documents),
news AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS scored FROM news0)"""
UNIVERSE = f"""universe AS (SELECT DISTINCT symbol FROM (SELECT upper(w) AS symbol FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) q
  WHERE length(w) >= 8 UNION ALL SELECT {_EVSYM} FROM orders) z)"""
EVENTS = f"events0 AS (SELECT {', '.join(_sel(_EVENT))} FROM orders)"


# ---- result rows and parameters -----------------------------------------------------

_RESULT = {
    "symbol": "'S' || CAST(o_custkey % 40 AS VARCHAR(9))", "date": "CAST(o_orderdate AS DATE)",
    "gamma": "CASE o_orderpriority WHEN '5-LOW' THEN 1e-2 WHEN '2-HIGH' THEN 2e-2 ELSE 5e-2 END",
    "kappa": "CASE o_orderstatus WHEN 'O' THEN 1e0 WHEN 'F' THEN 15e-1 ELSE 3e0 END", "pnl": "o_totalprice * 987654321e-9 - 251237.731e0",
}


def results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").selectExpr(*_sel(_RESULT))
    return r.groupBy("symbol", "date", "gamma", "kappa").agg(
        F.sum("pnl").alias("net_pnl"), (F.avg("pnl") / 100000).alias("sharpe"))


RESULTS = f"""r0 AS (SELECT {', '.join(_sel(_RESULT))} FROM orders),
results AS (SELECT symbol, date, gamma, kappa, sum(pnl) AS net_pnl, avg(pnl) / 100000 AS sharpe FROM r0 GROUP BY ALL)"""
