"""Sources, sinks, catalogues and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import (
    BAR, BARS, FILES, INSTRUMENTS, LAST_THU, STORED, TICKS, bars, bars_cte, files, instruments, stored, table, ticks,
)
from tickloom.functions import symbols as sy
from tickloom.functions.columns import ist_date
from tickloom.operators import catalogue as cat
from tickloom.operators import quality as ql
from tickloom.operators.bars import build_bars
from tickloom.plans import reports as rp
from tickloom.schema import ensure_columns
from tickloom.session import scratch_path
from tickloom.sources import storage as st
from tickloom.sources import ticks as tk

_MON = "|".join(sy.MONTHS)
_M = "'" + "".join(sy.MONTHS) + "'"
_sfx = rf"[0-9]{{2}}({_MON})FUT$"


def _mstart(sym):
    yy = rf"regexp_extract({sym}, '^(.*?)([0-9]{{2}})({_MON})FUT$', 2)"
    mm = rf"regexp_extract({sym}, '^(.*?)([0-9]{{2}})({_MON})FUT$', 3)"
    return f"make_date(2000 + CAST({yy} AS INTEGER), CAST((strpos({_M}, {mm}) + 2) // 3 AS INTEGER), 1)"


def _expiry(m):
    cases = " ".join(f"WHEN '{d[:7]}' THEN DATE '{d}'" for d in sy.EXPIRY_2026)
    return f"CASE strftime({m}, '%Y-%m') {cases} ELSE {LAST_THU.format(m=m)} END"


# ---- ticks -----------------------------------------------------------------

def _nested(s, d, t=None):
    """Ticks with a nested book of k % 7 levels per side (at most five are kept)."""
    t = ticks(s, d) if t is None else t
    n = (F.col("tick_id") % 7).cast("int")

    def side(x):
        levels = F.array(*[F.struct(F.col(f"{x}_p{i}").alias("price"), F.col(f"{x}_q{i}").alias("quantity"),
                                    F.lit(i).cast("bigint").alias("orders")) for i in range(1, 6)])
        return F.slice(levels, F.lit(1), F.least(n, F.lit(5)))

    return t.select(
        "ts_local_ns", F.lit(None).cast("string").alias("exchange_timestamp"), F.lit("x").alias("last_trade_time"),
        "symbol", "instrument_token", "last_price", F.col("last_qty").alias("last_traded_quantity"),
        F.col("avg_price").alias("average_traded_price"), F.col("volume").alias("volume_traded"),
        F.struct(F.col("last_price").alias("open"), F.col("last_price").alias("high"), F.col("last_price").alias("low"),
                 F.col("last_price").alias("close")).alias("ohlc"),
        "oi", F.lit(None).cast("bigint").alias("oi_day_high"), F.lit(None).cast("bigint").alias("oi_day_low"),
        F.col("total_bid_qty").alias("total_buy_quantity"), F.col("total_ask_qty").alias("total_sell_quantity"),
        F.struct(side("bid").alias("buy"), side("ask").alias("sell")).alias("depth"))


_lv = ", ".join(f"CASE WHEN tick_id % 7 >= {i} THEN {s}_{k}{i} ELSE 0 END AS {s}_{k}{i}"
                for s in ("bid", "ask") for i in range(1, 6) for k in "pq")
_lv_cols = " ".join(f"{s}_{k}{i}:{'6' if k == 'p' else 'l'}" for s in ("bid", "ask") for i in (1, 3, 5) for k in "pq")
add("P4_flatten_book", lambda s, d: tk.flatten_depth(_nested(s, d)).withColumn("o5", F.col("bid_o5")),
    f"ts_local_ns symbol mid_price:3 spread:3 book_imbalance:6 o5:l oi_day_high:l ts_exchange {_lv_cols}",
    f"""WITH {TICKS}
SELECT ts_local_ns, symbol, CASE WHEN tick_id % 7 >= 1 THEN round((bid_p1 + ask_p1) / 2 + 1e-9, 2) ELSE 0 END AS mid_price,
  CASE WHEN tick_id % 7 >= 1 THEN round(ask_p1 - bid_p1, 2) ELSE 0 END AS spread, round(book_imbalance, 6) AS book_imbalance,
  CASE WHEN tick_id % 7 >= 5 THEN 5 ELSE 0 END AS o5, 0 AS oi_day_high, '' AS ts_exchange, {_lv} FROM ticks""")


def _text_feed(s, d):
    t = ticks(s, d)
    cols = {}
    for x, y in (("bid", "b"), ("ask", "s")):
        for i in range(1, 11):
            if i <= 5:
                bad = (F.col("tick_id") + i) % 9 == 0
                cols[f"{y}p{i}"] = F.when(bad, "n/a").otherwise(F.col(f"{x}_p{i}").cast("string"))
                cols[f"{y}q{i}"] = F.col(f"{x}_q{i}").cast("string")
            else:
                cols[f"{y}p{i}"], cols[f"{y}q{i}"] = F.lit(None).cast("string"), F.lit("")
    return t.select("tick_id", "ts_local_ns", "symbol", F.col("last_price").cast("string").alias("lp"),
                    F.col("volume").cast("string").alias("v"), *[c.alias(n) for n, c in cols.items()])


_ok = "(tick_id + 1) % 9 <> 0"
add("P4_text_book", lambda s, d: tk.parse_text_levels(_text_feed(s, d)),
    "tick_id symbol last_price:6 volume:l bid_p1:6 ask_p2:6 bid_q5:l ask_p10:6 total_bid_qty:l mid_price:3 spread:3 book_imbalance:6",
    f"""WITH {TICKS}
SELECT tick_id, symbol, last_price, volume, CASE WHEN {_ok} THEN bid_p1 ELSE 0 END AS bid_p1,
  CASE WHEN (tick_id + 2) % 9 <> 0 THEN ask_p2 ELSE 0 END AS ask_p2, bid_q5, 0 AS ask_p10, total_bid_qty,
  CASE WHEN {_ok} AND bid_p1 <> 0 AND ask_p1 <> 0 THEN round((bid_p1 + ask_p1) / 2 + 1e-9, 2) ELSE 0 END AS mid_price,
  CASE WHEN {_ok} AND bid_p1 <> 0 AND ask_p1 <> 0 THEN round(ask_p1 - bid_p1, 2) ELSE 0 END AS spread, round(book_imbalance, 6) AS book_imbalance FROM ticks""")


def _two_feeds(s, d):
    a = tk.flatten_depth(_nested(s, d)).withColumn("feed", F.lit("a"))
    b = tk.parse_text_levels(_text_feed(s, d)).drop("tick_id").withColumn("feed", F.lit("b"))
    return tk.combine(a, b)


add("U1_union_feeds",
    lambda s, d: _two_feeds(s, d).groupBy("feed", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("ask_p10").alias("n_deep"), F.count("bid_o1").alias("n_orders"),
        F.sum("total_bid_qty").alias("qty")),
    "feed symbol n:l n_deep:l n_orders:l qty:l",
    f"""WITH {TICKS}
SELECT feed, symbol, count(*) AS n, CASE WHEN feed = 'b' THEN count(*) ELSE 0 END AS n_deep,
  CASE WHEN feed = 'a' THEN count(*) ELSE 0 END AS n_orders, sum(total_bid_qty) AS qty FROM ticks, (VALUES ('a'), ('b')) AS f(feed) GROUP BY feed, symbol""")


def _tick_store(s, d):
    path = scratch_path(s, "ticks")
    st.write_ticks(ticks(s, d), path)
    return path


def _bar_store(s, d):
    path = scratch_path(s, "bars")
    st.write_bars(bars(s, d), path)
    return path


def _dated(df, *more):
    """The schema of a stored table: that of ``df`` and its partition columns."""
    kinds = {"date": "date", "base": "string"}
    return df.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("date", *more) if c not in df.columns]).schema


add("S1_scan_ticks",
    lambda s, d: st.scan(s, _tick_store(s, d), _dated(ticks(s, d)), start="2024-01-05", end="2024-01-20", symbols=["click", "view"])
    .select("tick_id", "symbol", "date", "last_price"),
    "tick_id symbol date:d last_price:6",
    f"""WITH {TICKS}, x AS (SELECT *, DATE '1970-01-01' + CAST((ts_local_ns // 1000000000 + 19800) // 86400 AS INTEGER) AS date FROM ticks)
SELECT * FROM x WHERE symbol IN ('click', 'view') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
add("S2_load_day", lambda s, d: st.load_day(s, _bar_store(s, d), _dated(bars(s, d), "base"), "click", "2024-01-10"), "symbol ts_sec close:6 tick_count:l",
    f"{BARS}\nSELECT * FROM bars WHERE symbol = 'click' AND date = DATE '2024-01-10' AND ist_tod BETWEEN 33300 AND 55800")


def _contract_bars(s, d):
    t = ticks(s, d).join(stored(s, d).select(F.col("event_id").alias("tick_id"), "base", "contract", "layout"), "tick_id")
    g = build_bars(t.withColumn("symbol", F.concat_ws("|", "base", "contract", "layout")), BAR, ladder=False)
    p = F.split("symbol", r"\|")
    return g.withColumns({"base": p[0], "contract": p[1], "layout": p[2]})


_BEST = f"""{FILES}, best AS (SELECT *, CASE layout WHEN 'new' THEN 0 ELSE 2 END AS priority, row_number() OVER (PARTITION BY base, date
  ORDER BY CASE layout WHEN 'new' THEN 0 ELSE 2 END, {_mstart('contract')} DESC, contract DESC) AS rn FROM files)"""
add("S3_load_range", lambda s, d: st.load_range(_contract_bars(s, d), "2024-01-03", "2024-01-24"),
    "base contract layout ts_sec close:6 tick_count:l",
    f"""WITH {TICKS}, {STORED}, f2 AS (SELECT base, contract, layout, DATE '1970-01-01' + CAST((epoch_us(e.ts) // 1000000 + 19800) // 86400 AS INTEGER) AS date,
    e.event_id FROM stored JOIN events e USING (event_id)),
fx AS (SELECT DISTINCT base, contract, layout, date FROM f2 WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-24'),
rk AS (SELECT *, row_number() OVER (PARTITION BY base, date ORDER BY CASE layout WHEN 'new' THEN 0 ELSE 2 END, {_mstart('contract')} DESC) AS rn FROM fx),
j AS (SELECT f2.*, t.last_price, t.ts_local_ns, (t.ts_local_ns // 1000000000) // {BAR} * {BAR} AS ts_sec FROM ticks t JOIN f2 ON t.tick_id = f2.event_id
  JOIN rk USING (base, contract, layout, date) WHERE rn = 1)
SELECT base, contract, layout, ts_sec, last(last_price ORDER BY ts_local_ns, event_id) AS close, count(*) AS tick_count FROM j
WHERE (ts_sec + 19800) % 86400 BETWEEN 33300 AND 55800 GROUP BY 1, 2, 3, 4""")
add("S4_source_priority", lambda s, d: cat.best_source(files(s, d)), "base date:d contract layout priority:l",
    f"WITH {_BEST}\nSELECT * FROM best WHERE rn = 1")
add("W35_latest_contract", lambda s, d: cat.best_source(files(s, d).where("layout = 'flat'")), "base date:d contract",
    f"WITH {_BEST.replace('FROM files)', 'FROM files WHERE layout = ' + chr(39) + 'flat' + chr(39) + ')')}\nSELECT * FROM best WHERE rn = 1")
add("S7_active_bases", lambda s, d: cat.active_bases(files(s, d), "2024-01-05", "2024-01-25"), "base",
    f"WITH {FILES}\nSELECT DISTINCT base FROM files WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
add("S8_active_contracts", lambda s, d: cat.active_contracts(files(s, d), "2024-01-27", "2024-01-30"), "base contract expiry:d",
    f"""WITH {FILES}, c AS (SELECT DISTINCT base, contract, {_expiry(_mstart('contract'))} AS expiry FROM files
  WHERE date BETWEEN DATE '2024-01-27' AND DATE '2024-01-30')
SELECT * FROM c WHERE expiry >= DATE '2024-01-27' QUALIFY row_number() OVER (PARTITION BY base ORDER BY expiry DESC, contract DESC) = 1""")


def _sink(s, d):
    path = _bar_store(s, d)
    one = bars(s, d).where(F.col("date") == F.lit("2024-01-10").cast("date"))
    st.write_bars(one.withColumn("close", F.col("close") + 1), path)
    return st.scan(s, path, _dated(bars(s, d), "base"), key="base")


add("S9_partition_sink", _sink, "symbol ts_sec date:d close:6",
    f"{BARS}\nSELECT symbol, ts_sec, date, CASE WHEN date = DATE '2024-01-10' THEN close + 1 ELSE close END AS close FROM bars")


def _warehouse(s, d):
    name = "raw_orderbook_" + scratch_path(s, "t")[-6:]
    t = ticks(s, d).withColumn("date", ist_date(F.floor(F.col("ts_local_ns") / 1_000_000_000)))
    path = scratch_path(s, "table")
    st.load_table(t, name, path, ["2024-01-15"])
    kept = s.table(name).count()
    s.sql(f"DROP TABLE {name}")  # its files stay
    found = s.read.parquet(path)
    if found.count() != kept:
        raise RuntimeError("the table and its files differ")
    return found.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"))


_TD = f"WITH {TICKS}, x AS (SELECT *, DATE '1970-01-01' + CAST((ts_local_ns // 1000000000 + 19800) // 86400 AS INTEGER) AS date FROM ticks)"
add("S11_table_load", _warehouse, "symbol date:d n:l",
    f"{_TD}\nSELECT symbol, date, count(*) AS n FROM x WHERE date <> DATE '2024-01-15' GROUP BY 1, 2")
add("S12_adhoc_sql",
    lambda s, d: st.query(s, "SELECT symbol, count(*) AS n, avg(last_price) AS avg_price, max(spread) AS max_spread FROM raw_ticks GROUP BY symbol",
                          raw_ticks=ticks(s, d)),
    "symbol n:l avg_price:6 max_spread:6",
    f"WITH {TICKS}\nSELECT symbol, count(*) AS n, avg(last_price) AS avg_price, max(spread) AS max_spread FROM ticks GROUP BY symbol")


def _csv(s, d):
    inv = cat.inventory(bars(s, d)).select("symbol", "n_bars", "n_dates", "avg_price")
    p = scratch_path(s, "csv")
    st.write_csv(inv, p)
    return s.read.schema(inv.schema).option("header", "true").csv(p)


def _json(s, d):
    inv = cat.inventory(bars(s, d)).select("symbol", "n_bars", "n_dates", "avg_price")
    p = scratch_path(s, "json")
    st.write_json(inv, p)
    return s.read.schema(inv.schema).json(p)


_INV = f"""{BARS}
SELECT symbol, count(*) AS n_bars, count(DISTINCT date) AS n_dates, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts,
  avg(close) AS avg_price, avg(spread_mean) AS avg_spread, avg(tick_count) AS avg_ticks FROM bars GROUP BY symbol"""
add("S13_csv_sink", _csv, "symbol n_bars:l n_dates:l avg_price:6", _INV)
add("S13_json_sink", _json, "symbol n_bars:l n_dates:l avg_price:6", _INV)
_PJ = ("'{\"' || symbol || '\": {\"gamma\": 0.0' || lpad(CAST(p_size AS VARCHAR(3)), 2, '0') || ', \"kappa\": ' || "
       "CAST(p_size AS VARCHAR(3)) || '.5}, \"_meta\": {\"version\": 2}}'")
add("S14_json_params", lambda s, d: st.read_params(instruments(s, d).selectExpr("p_partkey", f"{_PJ} AS json")),
    "p_partkey:l symbol key value:6",
    f"""WITH {INSTRUMENTS}
SELECT p_partkey, symbol, key, CASE key WHEN 'gamma' THEN p_size / 1000 ELSE p_size + 5e-1 END AS value
FROM instruments, (VALUES ('gamma'), ('kappa')) AS k(key)""")
add("S15_expired_partitions",
    lambda s, d: st.expired_partitions(files(s, d).select("contract", "date").distinct(), "2024-01-25", 10),
    "contract date:d age_days:l",
    f"WITH {FILES}\nSELECT DISTINCT contract, date, DATE '2024-01-25' - date AS age_days FROM files WHERE DATE '2024-01-25' - date > 10")

# ---- jobs, inventory, coverage ------------------------------------------------

_KEY = "CAST(user_id AS VARCHAR(20)) AS symbol", "date"


def _raw_jobs(s, d):
    return stored(s, d).selectExpr(*_KEY).distinct()


def _done_jobs(s, d):
    return (stored(s, d).where("event_type IN ('purchase', 'click')").selectExpr(*_KEY)
            .groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n_rows")))


_JOBS = f"""WITH {STORED}, raw AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol, date FROM stored),
done AS (SELECT CAST(user_id AS VARCHAR) AS symbol, date, count(*) AS n_rows FROM stored WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2),
open AS (SELECT symbol, date, 'missing' AS reason FROM raw ANTI JOIN done USING (symbol, date)
  UNION ALL SELECT symbol, date, 'incomplete' FROM raw SEMI JOIN (SELECT * FROM done WHERE n_rows < 2) q USING (symbol, date))"""
add("J6_open_jobs", lambda s, d: cat.open_jobs(_raw_jobs(s, d), _done_jobs(s, d), 2), "symbol date:d reason", f"{_JOBS}\nSELECT * FROM open")
add("U4_job_sets", lambda s, d: cat.job_sets(_raw_jobs(s, d), _done_jobs(s, d)), "symbol date:d set",
    f"""{_JOBS}, a AS (SELECT symbol, date FROM raw), b AS (SELECT symbol, date FROM done),
u AS (SELECT *, 'pending' AS "set" FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'done' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
  UNION ALL SELECT *, 'all' FROM (SELECT * FROM a UNION SELECT * FROM b))
SELECT * FROM u""")
add("A28_inventory", lambda s, d: cat.inventory(bars(s, d)),
    "symbol n_bars:l n_dates:l first_ts:l last_ts:l avg_price:6 avg_spread:6 avg_ticks:6", _INV)
add("A28_class_coverage", lambda s, d: cat.class_coverage(files(s, d), 30), "date:d class n_files:l n_symbols:l status",
    f"""WITH {FILES}
SELECT date, 'FUT' AS class, sum(n_files) AS n_files, count(DISTINCT contract) AS n_symbols,
  CASE WHEN sum(n_files) > 30 THEN 'GOOD' ELSE 'PARTIAL' END AS status FROM files GROUP BY date""")
add("O6_most_dates", lambda s, d: cat.most_dates(_raw_jobs(s, d)).withColumn("dates", F.concat_ws(",", F.transform("dates", lambda x: x.cast("string")))),
    "symbol n_dates:l dates",
    f"{_JOBS}\nSELECT symbol, count(*) AS n_dates, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates FROM raw GROUP BY 1 ORDER BY n_dates DESC, symbol LIMIT 20")
_GAPS = f"""WITH {TICKS}, {bars_cte(60)},
pm AS (SELECT symbol, date, ist_tod // 60 AS m, 1 AS n FROM bars),
k AS (SELECT DISTINCT symbol, date FROM bars),
grid AS (SELECT symbol, date, unnest(range(555, 930)) AS m FROM k),
ms AS (SELECT g.* FROM grid g ANTI JOIN pm USING (symbol, date, m)),
il AS (SELECT *, m - row_number() OVER (PARTITION BY symbol, date ORDER BY m) AS g FROM ms),
st AS (SELECT symbol, date, g, count(*) AS len FROM il GROUP BY 1, 2, 3),
mx AS (SELECT symbol, date, max(len) AS max_gap, sum(len) AS n_missing FROM st GROUP BY 1, 2),
ml AS (SELECT symbol, date, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS missing FROM ms GROUP BY 1, 2),
rw AS (SELECT symbol, date, count(*) FILTER (ist_tod // 60 BETWEEN 555 AND 929) AS rows FROM bars GROUP BY 1, 2),
cov AS (SELECT symbol, date, rows, 375 AS expected_minutes, coalesce(n_missing, 0) AS n_missing, coalesce(max_gap, 0) AS max_gap,
  (375 - coalesce(n_missing, 0)) / 375 AS coverage, coalesce(missing, '') AS missing FROM rw LEFT JOIN mx USING (symbol, date) LEFT JOIN ml USING (symbol, date)),
gaps AS (SELECT *, coverage < 5e-1 AS low_coverage, max_gap >= 5 AS large_gap, CASE WHEN rows = 0 THEN 'NO_DATA_IN_MARKET_HOURS'
  WHEN coverage < 5e-1 AND max_gap >= 5 THEN 'LOW_COVERAGE, LARGE_GAP' WHEN max_gap >= 5 THEN 'LARGE_GAP'
  WHEN coverage < 5e-1 THEN 'LOW_COVERAGE, MINOR_GAPS' WHEN n_missing > 0 THEN 'MINOR_GAPS' ELSE 'OK' END AS status FROM cov)"""


def _cov(s, d):
    return ql.minute_coverage(bars(s, d, 60))


add("A27_minute_coverage", lambda s, d: _cov(s, d).withColumn("missing", F.concat_ws(",", F.transform("missing", lambda x: x.cast("string")))),
    "symbol date:d rows:l expected_minutes:l n_missing:l missing max_gap:l coverage:6 low_coverage:b large_gap:b status",
    f"{_GAPS}\nSELECT * FROM gaps")
add("W33_longest_missing_streak", _cov, "symbol date:d max_gap:l", f"{_GAPS}\nSELECT * FROM gaps")
add("C29_health_report", lambda s, d: rp.coverage_report(bars(s, d, 60), 5)[1],
    "date:d found:l ok:l no_data:l low_coverage:l large_gaps:l minor_gaps:l overall",
    f"""{_GAPS}, h AS (SELECT date, count(*) AS found, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (contains(status, 'NO_DATA')) AS no_data,
  count(*) FILTER (low_coverage) AS low_coverage, count(*) FILTER (large_gap) AS large_gaps, count(*) FILTER (contains(status, 'MINOR_GAPS')) AS minor_gaps
  FROM gaps GROUP BY date)
SELECT *, CASE WHEN found < 4 THEN 'CRITICAL' WHEN found < 475e-2 OR large_gaps > 0 OR low_coverage > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS overall FROM h""")

# ---- symbols and calendar --------------------------------------------------------

add("F1_strip_contract", lambda s, d: instruments(s, d).withColumn("base", sy.strip_contract("symbol")), "p_partkey:l symbol base",
    f"WITH {INSTRUMENTS}\nSELECT *, regexp_replace(symbol, '{_sfx}', '') AS base FROM instruments")
add("F2_previous_contract", lambda s, d: instruments(s, d).withColumn("previous", sy.previous_contract("symbol")), "p_partkey:l symbol previous",
    f"""WITH {INSTRUMENTS}, m AS (SELECT *, CASE WHEN regexp_matches(symbol, '{_sfx}') THEN {_mstart('symbol')} - INTERVAL 1 MONTH END AS pm FROM instruments)
SELECT *, CASE WHEN pm IS NOT NULL THEN regexp_replace(symbol, '{_sfx}', '') || upper(strftime(pm, '%y%b')) || 'FUT' END AS previous FROM m""")
_opt = rf"'^([A-Z&-]+?)([0-9]{{2}})({_MON})([0-9]+)(CE|PE)$'"
_wkl = r"'^([A-Z&-]+?)([0-9]{2})([1-9OND])([0-9]{2})([0-9]+)(CE|PE)$'"
_ms = f"make_date(2000 + CAST(regexp_extract(symbol, {_opt}, 2) AS INTEGER), CAST((strpos({_M}, regexp_extract(symbol, {_opt}, 3)) + 2) // 3 AS INTEGER), 1)"
PARSED = f"""parsed AS (SELECT *, CASE WHEN regexp_matches(symbol, {_opt}) THEN regexp_extract(symbol, {_opt}, 1) WHEN regexp_matches(symbol, {_wkl}) THEN regexp_extract(symbol, {_wkl}, 1) END AS underlying,
  CASE WHEN regexp_matches(symbol, {_opt}) THEN CAST(regexp_extract(symbol, {_opt}, 4) AS DOUBLE) WHEN regexp_matches(symbol, {_wkl}) THEN CAST(regexp_extract(symbol, {_wkl}, 5) AS DOUBLE) END AS strike,
  CASE WHEN regexp_matches(symbol, {_opt}) THEN regexp_extract(symbol, {_opt}, 5) WHEN regexp_matches(symbol, {_wkl}) THEN regexp_extract(symbol, {_wkl}, 6) END AS opt_type,
  CASE WHEN regexp_matches(symbol, {_opt}) THEN {LAST_THU.format(m=_ms)}
    WHEN regexp_matches(symbol, {_wkl}) THEN make_date(2000 + CAST(regexp_extract(symbol, {_wkl}, 2) AS INTEGER),
      CAST(CASE regexp_extract(symbol, {_wkl}, 3) WHEN 'O' THEN '10' WHEN 'N' THEN '11' WHEN 'D' THEN '12' ELSE regexp_extract(symbol, {_wkl}, 3) END AS INTEGER),
      CAST(regexp_extract(symbol, {_wkl}, 4) AS INTEGER)) END AS expiry FROM instruments)"""
add("F3_parse_option", lambda s, d: sy.parse_options(instruments(s, d)), "p_partkey:l symbol underlying strike:2 opt_type expiry:d",
    f"WITH {INSTRUMENTS}, {PARSED}\nSELECT * FROM parsed")
add("F4_contract_expiry",
    lambda s, d: instruments(s, d).withColumn("expiry", sy.contract_expiry(sy.contract_month("symbol"))).where("expiry IS NOT NULL")
    .withColumn("expired", F.lit("2026-04-25").cast("date") > F.col("expiry")),
    "p_partkey:l symbol expiry:d expired:b",
    f"""WITH {INSTRUMENTS}, m AS (SELECT *, {_expiry(_mstart('symbol'))} AS expiry FROM instruments WHERE regexp_matches(symbol, '{_sfx}'))
SELECT *, DATE '2026-04-25' > expiry AS expired FROM m""")


def _dates(s, d):
    """Order dates moved 25 years on, so that they meet the listed expiries and holidays."""
    return table(s, d, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 300).alias("date")).distinct()


_DATES = "dts AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 300 MONTH AS DATE) AS date FROM orders)"


def _cur(x):
    m = f"CAST(date_trunc('month', {x}) AS DATE)"
    return f"upper(strftime(CASE WHEN {x} > {_expiry(m)} THEN {m} + INTERVAL 1 MONTH ELSE {m} END, '%b')) || 'FUT'"


add("F5_roll_days", lambda s, d: sy.roll_days(_dates(s, d)), "date:d contract old_contract is_roll_day:b",
    f"""WITH {_DATES}, p AS (SELECT date, date - CASE isodow(date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS prev FROM dts),
c AS (SELECT date, {_cur('date')} AS contract, {_cur('prev')} AS old_contract FROM p)
SELECT *, contract <> old_contract AS is_roll_day FROM c""")
add("F6_trading_calendar", lambda s, d: sy.recent_trading_dates(_dates(s, d), sy.holidays(s), 5), "date:d day:d nth:l",
    f"""WITH {_DATES}, c AS (SELECT date, date - CAST(k AS INTEGER) AS day FROM dts, range(1, 61) AS r(k)),
f AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY day DESC) AS nth FROM c WHERE isodow(day) < 6
  AND day NOT IN ({', '.join(f"DATE '{h}'" for h in sy.HOLIDAYS_2026)}))
SELECT * FROM f WHERE nth <= 5""")
add("P14_instrument_class", lambda s, d: instruments(s, d).withColumn("class", sy.instrument_class("symbol")), "p_partkey:l symbol class",
    f"""WITH {INSTRUMENTS}
SELECT *, CASE p_size % 6 WHEN 0 THEN 'FUT' WHEN 1 THEN 'CE' WHEN 2 THEN 'PE' WHEN 3 THEN 'CE' WHEN 4 THEN 'SPOT' ELSE 'CURRENCY' END AS class FROM instruments""")
add("F9_ensure_columns", lambda s, d: ensure_columns(bars(s, d), {"imbalance_std": 0.0, "lot_size": 75.0}),
    "symbol ts_sec imbalance_std:6 lot_size:2",
    f"{BARS}\nSELECT symbol, ts_sec, coalesce(imbalance_std, 0) AS imbalance_std, 75 AS lot_size FROM bars")
