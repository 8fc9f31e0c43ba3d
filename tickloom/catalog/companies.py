"""Company fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import add
from tickloom.catalog.standin import table
from tickloom.operators import fundamentals as fd

_T = "CAST({x} AS VARCHAR(20))"


def _t(x):
    return _T.format(x=x)


def _cols(*values):
    return "[' || " + " || ',' || ".join("'{\"value\": \"' || " + v + " || '\"}'" for v in values) + " || ']"


_k = "c_custkey"
_JSON = (
    "'{\"ratios\": [{\"name\": \"Return on Equity\", \"values\": [{\"value\": \"1\"}, {\"value\": \"' || " + _t(f"{_k} % 30") + " || '.5%\"}]}, "
    "{\"name\": \"Debt to Equity\", \"values\": [{\"value\": \"' || " + _t(f"{_k} % 3") + " || '.25\"}]}, "
    "{\"name\": \"Market Cap\", \"values\": [{\"value\": \"' || " + _t(f"1 + {_k} % 90") + " || ',250\"}]}' || "
    f"CASE WHEN {_k} % 4 = 0 THEN '' ELSE ', {{\"name\": \"Price to Earning\", \"values\": [{{\"value\": \"' || " + _t(f"5 + {_k} % 40") + " || '\"}]}' END || "
    "'], \"profit_loss\": {\"rows\": [{\"title\": \"Sales\", \"columns\": " + _cols(_t(f"100 + {_k} % 50"), "'120'", "'n/a'", "'1,30'", _t(f"140 + {_k} % 90")) + "}, "
    "{\"title\": \"Net Profit\", \"columns\": " + _cols(_t(f"10 + {_k} % 7"), _t(f"12 + {_k} % 5"), _t(f"11 + {_k} % 3"), _t(f"15 + {_k} % 11")) + "}]}, "
    "\"cash_flows\": {\"rows\": [{\"title\": \"Cash from Operating Activity\", \"columns\": " + _cols("'8'", _t(f"{_k} % 20")) + "}]}, "
    "\"shareholding\": {\"rows\": [{\"title\": \"Promoters\", \"columns\": " + _cols("'40'", _t(f"35 + {_k} % 40") + " || '%'") + "}, "
    "{\"title\": \"Promoter Pledging\", \"columns\": " + _cols(_t(f"{_k} % 60")) + "}]}}'")


def _docs(s, d):
    return table(s, d, "customer").selectExpr(f"concat('C', cast({_k} as string)) AS symbol", f"{_JSON} AS json")


_SNAP = f"""WITH v AS (SELECT 'C' || c_custkey AS symbol, c_custkey AS k FROM customer),
snap AS (SELECT symbol, k % 30 + 5e-1 AS roe, k % 3 + 25e-2 AS debt_equity, (1 + k % 90) * 1000 + 250 AS market_cap, CASE WHEN k % 4 <> 0 THEN 5 + k % 40 END AS pe_ratio,
  round((pow((140 + k % 90) / (100 + k % 50), 1e0 / 3) - 1) * 100, 1) AS revenue_growth_3yr, round((pow((15 + k % 11) / (10 + k % 7), 1e0 / 3) - 1) * 100, 1) AS pat_growth_3yr,
  (8 + k % 20) / 2 / (15 + k % 11) AS cash_flow_pat_ratio, 35 + k % 40 AS promoter_holding, k % 60 AS promoter_pledging,
  (SELECT stddev(x) FROM (VALUES (12 + k % 5), (11 + k % 3), (15 + k % 11)) AS z(x)) AS pat_std_3yr, 'GOOD' AS data_quality FROM v)"""
add("F23_numeric_text", lambda s, d: table(s, d, "customer").selectExpr("c_custkey", "concat(format_number(c_acctbal, 2), '%') AS t").withColumn("value", fd.number(F.col("t"))),
    "c_custkey:l value:2", "WITH c AS (SELECT c_custkey, c_acctbal AS value FROM customer)\nSELECT * FROM c")
add("F24_growth_and_grade", lambda s, d: fd.snapshot(_docs(s, d)), "symbol revenue_growth_3yr:1 pat_growth_3yr:1 pat_std_3yr:6 data_quality", f"{_SNAP}\nSELECT * FROM snap")
add("C8_fundamentals_snapshot", lambda s, d: fd.snapshot(_docs(s, d)),
    "symbol roe:2 debt_equity:2 market_cap:2 pe_ratio:2 revenue_growth_3yr:1 pat_growth_3yr:1 cash_flow_pat_ratio:6 promoter_holding:2 promoter_pledging:2 data_quality",
    f"{_SNAP}\nSELECT * FROM snap")

_CO = {
    "symbol": "'C' || CAST(c_custkey AS VARCHAR(20))", "roe": "(c_custkey % 30) * 1e0", "roce": "(c_custkey % 20) * 1e0",
    "net_profit_margin": "c_acctbal / 500", "revenue_growth": "(c_custkey % 35) * 1e0", "eps_growth": "(c_custkey % 40) * 1e0",
    "debt_equity": "(c_custkey % 28) / 1e1", "current_ratio": "(c_custkey % 25) / 1e1", "free_cash_flow": "c_acctbal",
    "net_profit": "c_custkey % 9000 * 1e0 + 1", "promoter_holding": "(c_custkey % 75) * 1e0", "promoter_pledging": "(c_custkey % 61) * 1e0",
    "audit_qualification": "c_custkey % 17 = 0", "days_to_earnings": "CAST(c_custkey % 23 AS INTEGER)", "c_nationkey": "c_nationkey",
}
_SEL = ", ".join(f"{e} AS {n}" for n, e in _CO.items())


def _companies(s, d):
    return table(s, d, "customer").selectExpr(*[f"{e} AS {n}" for n, e in _CO.items()])


def _lad(x, steps, op=">"):
    return "CASE " + " ".join(f"WHEN {x} {op} {a} THEN {p}" for a, p in steps) + " ELSE 0 END"


_Q = f"""WITH co AS (SELECT {_SEL} FROM customer),
qs AS (SELECT *, greatest(0, least(100, {_lad('roe', ((20, 10), (15, 7), (10, 4)))} + {_lad('roce', ((15, 10), (12, 7), (8, 4)))} + {_lad('net_profit_margin', ((15, 10), (8, 7), (4, 4)))}
  + {_lad('revenue_growth', ((20, 10), (10, 7), (5, 4)))} + {_lad('eps_growth', ((25, 15), (15, 10), (5, 5)))} + {_lad('debt_equity', ((0.3, 15), (0.7, 10), (1.0, 5), (2.0, 2)), '<')}
  + {_lad('current_ratio', ((2.0, 10), (1.5, 7), (1.0, 4)))} + {_lad('free_cash_flow / greatest(abs(net_profit), 1)', ((0.9, 10), (0.7, 7), (0.5, 4)))}
  + {_lad('promoter_holding', ((60, 10), (50, 7), (40, 4)))} - {_lad('promoter_pledging', ((50, 20), (30, 10), (10, 5)))} - CASE WHEN audit_qualification THEN 15 ELSE 0 END)) AS quality FROM co)"""
add("F25_quality_score", lambda s, d: fd.quality_score(_companies(s, d)), "symbol quality:2", f"{_Q}\nSELECT * FROM qs")


def _rec_sql(field):
    rules = (("audit_qualification OR promoter_pledging > 50 OR (debt_equity > 2 AND quality < 30)", "avoid", 0.0), ("days_to_earnings <= 1", "cautious", 2.0),
             ("days_to_earnings <= 3", "cautious", 1.7), ("days_to_earnings <= 7", "cautious", 1.3), ("quality >= 70 AND debt_equity > 2", "normal", 1.0),
             ("quality >= 70", "aggressive", 0.85), ("quality >= 50", "normal", 1.0), ("quality >= 30", "cautious", 1.2), ("promoter_pledging > 30", "cautious", 1.5))
    out = "CASE " + " ".join(f"WHEN {c} THEN {repr(n) if field == 'r' else m}" for c, n, m in rules)
    return out + (" ELSE 'cautious' END" if field == "r" else " ELSE 1.3 END")


add("F26_recommendation", lambda s, d: fd.recommendation(fd.quality_score(_companies(s, d))), "symbol recommendation spread_multiplier:4",
    f"{_Q}\nSELECT *, {_rec_sql('r')} AS recommendation, {_rec_sql('m')} AS spread_multiplier FROM qs")


def _earnings(s, d):
    """A customer's orders as quarters: the rounded price is the estimate."""
    return table(s, d, "orders").selectExpr(
        "concat('C', cast(o_custkey as string)) AS symbol", "o_orderkey AS quarter",
        "CAST(o_orderkey % 7 * 10 AS DOUBLE) AS eps_estimate", "o_totalprice * 987654321e-9 / 8000 AS eps_actual")


_ES = """eh AS (SELECT 'C' || o_custkey AS symbol, o_orderkey AS quarter, o_orderkey % 7 * 1e1 AS e, o_totalprice * 987654321e-9 / 8000 AS a FROM orders),
e8 AS (SELECT * FROM eh QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) <= 8),
e9 AS (SELECT symbol, (a - e) / abs(e) * 100 AS s, row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) AS k FROM e8 WHERE e <> 0),
ea AS (SELECT symbol, count(*) AS n, avg(CAST(s > 0 AS INTEGER)) AS beat_rate, avg(s) AS avg_surprise_pct, avg(s) FILTER (k <= 2) AS nw, avg(s) FILTER (k IN (3, 4)) AS od FROM e9 GROUP BY 1),
es AS (SELECT *, CASE WHEN n >= 4 AND nw > od + 2 THEN 'improving' WHEN n >= 4 AND nw < od - 2 THEN 'declining' ELSE 'stable' END AS trend,
  greatest(-5e-3, least(5e-3, (round(beat_rate, 3) - 5e-1) * 1e-2)) AS alpha_prior FROM ea)"""
add("F27_earnings_surprise", lambda s, d: fd.earnings_surprise(_earnings(s, d)), "symbol n:l beat_rate:6 avg_surprise_pct:4 trend alpha_prior:6", f"WITH {_ES}\nSELECT * FROM es")


def _signals(s, d):
    c = _companies(s, d).drop("days_to_earnings")
    nat = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("sector"))
    sectors = c.select("symbol", "c_nationkey").join(nat, "c_nationkey").select("symbol", "sector")
    cal = table(s, d, "orders").selectExpr("concat('C', cast(o_custkey as string)) AS symbol", "cast(o_orderdate as date) AS earnings_date")
    return fd.signals(c, _earnings(s, d), sectors, cal, "2001-05-01")


add("C9_fundamental_signals", _signals,
    "symbol sector quality:2 days_to_earnings:l recommendation spread_multiplier:4 beat_rate:6 trend alpha_prior:6",
    f"""{_Q.replace("CAST(c_custkey % 23 AS INTEGER) AS days_to_earnings", "coalesce((SELECT min(CAST(o_orderdate AS DATE)) - DATE '2001-05-01' FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-05-01'), 999) AS days_to_earnings")}, {_ES}
SELECT qs.symbol, 'R' || n_regionkey AS sector, quality, days_to_earnings, {_rec_sql('r')} AS recommendation, {_rec_sql('m')} AS spread_multiplier,
  coalesce(beat_rate, 5e-1) AS beat_rate, coalesce(trend, 'stable') AS trend, coalesce(alpha_prior, 0) AS alpha_prior FROM qs JOIN nation ON n_nationkey = c_nationkey LEFT JOIN es USING (symbol)""")


def _outcomes(s, d):
    return table(s, d, "orders").selectExpr("concat('C', cast(o_custkey as string)) AS symbol", "o_totalprice * 987654321e-9 - 251237.731e0 AS p").groupBy("symbol").agg(
        F.sum("p").alias("test_pnl"), (F.avg("p") / F.max(F.abs("p"))).alias("test_sharpe"))


add("J15_quality_vs_results", lambda s, d: fd.quality_against_results(fd.quality_score(_companies(s, d)), _outcomes(s, d)),
    "n:l corr_sharpe:6 corr_pnl:6 corr_profitable:6",
    f"""{_Q}, o AS (SELECT 'C' || o_custkey AS symbol, sum(o_totalprice * 987654321e-9 - 251237.731e0) AS p, avg(o_totalprice * 987654321e-9 - 251237.731e0) / max(abs(o_totalprice * 987654321e-9 - 251237.731e0)) AS s FROM orders GROUP BY 1)
SELECT count(*) AS n, corr(quality, s) AS corr_sharpe, corr(quality, p) AS corr_pnl, corr(quality, CAST(p > 0 AS INTEGER)) AS corr_profitable FROM qs JOIN o USING (symbol)""")
