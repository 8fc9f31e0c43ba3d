"""Direction model and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.core import ORACLES, QUERIES, add
from tickloom.catalog.flow import _LINE
from tickloom.catalog.standin import BARS, FILLS, bars, fills
from tickloom.catalog.trades import _COST
from tickloom.functions.sql import register
from tickloom.operators import model as md
from tickloom.session import stage


def _direction(s, d):
    t = stage(md.enough_moves(md.training_table(bars(s, d), horizon=5, cross_day=True), 100), "training")
    split = F.lit("2024-01-22").cast("date")
    up, down = md.train(t.where(F.col("date") < split), max_iter=8, max_depth=4)
    scored = stage(md.predict(t.where(F.col("date") >= split), up, down).select("symbol", "label", "p_up", "p_down"), "scored")
    return md.verdicts(md.evaluate(scored), 50)


add("C7_direction_model", _direction, "symbol best_threshold:2 best_accuracy:6 n_signals:l n_rows:l verdict")


def _labelled(s, d):
    """Training rows with scores in closed form, so that all around the fit can be compared."""
    t = md.enough_moves(md.training_table(bars(s, d), horizon=5, cross_day=True), 100).select("symbol", "ts_sec", "label")
    slot = F.floor(F.col("ts_sec") / 1800)
    return t.withColumns({"p_up": (slot * 37 + F.length("symbol") * 11) % 100 / 100,
                          "p_down": (slot * 53 + F.length("symbol") * 7) % 100 / 100})


_LABELLED = f"""{BARS}, l0 AS (SELECT symbol, ts_sec, lead(coalesce(weighted_mid, close), 5) OVER {_LINE} / coalesce(weighted_mid, close) - 1 AS r FROM bars),
l1 AS (SELECT symbol, ts_sec, CASE WHEN r > 5e-4 THEN 1 WHEN r < -5e-4 THEN -1 ELSE 0 END AS label FROM l0 WHERE r IS NOT NULL),
sc AS (SELECT *, (ts_sec // 1800 * 37 + length(symbol) * 11) % 100 / 100.0::DOUBLE AS p_up, (ts_sec // 1800 * 53 + length(symbol) * 7) % 100 / 100.0::DOUBLE AS p_down
  FROM l1 WHERE symbol IN (SELECT symbol FROM l1 GROUP BY 1 HAVING count(*) FILTER (label <> 0) >= 100))"""
_EVALUATED = f"""{_LABELLED}, cl AS (SELECT *, CASE WHEN p_down > threshold THEN -1 WHEN p_up > threshold THEN 1 ELSE 0 END AS c
  FROM sc, (SELECT unnest([0.55, 0.6, 0.65]::DOUBLE[]) AS threshold) th),
ev AS (SELECT symbol, threshold, coalesce(avg(CASE WHEN label <> 0 AND c <> 0 THEN (c = label)::INT END), 0.5) AS accuracy,
  count(*) FILTER (label <> 0 AND c <> 0) AS n_signals, avg((c <> 0)::INT) AS signal_rate, count(*) AS n_rows FROM cl GROUP BY 1, 2)"""
_VERDICTS = f"""{_EVALUATED}, lo AS (SELECT symbol, min(threshold) AS t0, arg_min(accuracy, threshold) AS a0 FROM ev GROUP BY 1),
ve AS (SELECT symbol, threshold AS best_threshold, accuracy AS best_accuracy, n_signals, n_rows,
  CASE WHEN accuracy > 0.57 THEN 'STRONG' WHEN accuracy > 0.53 THEN 'USEFUL' ELSE 'WEAK' END AS verdict
  FROM ev JOIN lo USING (symbol) WHERE threshold = t0 OR (accuracy > a0 AND n_signals >= 50)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY accuracy DESC, threshold) = 1)"""
add("C7_training_table", _labelled, "symbol ts_sec label:l p_up:2 p_down:2", f"{_LABELLED}\nSELECT * FROM sc")
add("C7_evaluation", lambda s, d: md.evaluate(_labelled(s, d)), "symbol threshold:2 accuracy:6 n_signals:l signal_rate:6 n_rows:l",
    f"{_EVALUATED}\nSELECT * FROM ev")
add("C7_verdicts", lambda s, d: md.verdicts(md.evaluate(_labelled(s, d)), 50),
    "symbol best_threshold:2 best_accuracy:6 n_signals:l n_rows:l verdict", f"{_VERDICTS}\nSELECT * FROM ve")


def _thresholds(s, d):
    found = md.verdicts(md.evaluate(_labelled(s, d)), 50)
    own = found.select("symbol").union(found.select(F.concat("symbol", F.lit("26MAYFUT")))).union(found.select(F.concat(F.lit("no"), "symbol")))
    return md.thresholds_for(own, found)


add("C7_threshold_lookup", _thresholds, "symbol threshold:2 model_symbol",
    f"""{_VERDICTS}
SELECT symbol, best_threshold AS threshold, symbol AS model_symbol FROM ve UNION ALL SELECT symbol || '26MAYFUT', best_threshold, symbol FROM ve
UNION ALL SELECT 'no' || symbol, 0.6, NULL FROM ve""")


def _sql_functions(s, d):
    register(s)
    return fills(s, d).selectExpr(
        "symbol", "date", "l_orderkey", "l_linenumber", "l_partkey", "quantity", "l_tax",
        "strip_contract(concat('X', symbol, '26MAYFUT')) AS base", "ist_tod(l_orderkey) AS tod",
        "tc_cost(price, quantity, lot_size, side, instrument_type) AS cost")


add("X_sql_functions", _sql_functions, "symbol date:d l_orderkey:l l_linenumber:l l_partkey:l quantity:l l_tax:2 base tod:l cost:6",
    f"WITH {FILLS}, {_COST}\nSELECT *, 'X' || symbol AS base, (l_orderkey + 19800) % 86400 AS tod FROM cost")
for alias, name in {"X1_arrow_pricing_udf": "C4_implied_vol_greeks", "X2_grouped_episode_fold": "C18_threshold_episodes",
                    "X3_stateful_features": "T3_rolling_feature_stream"}.items():
    QUERIES[alias], ORACLES[alias] = QUERIES[name], ORACLES[name]
