"""Expressions offered as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tickloom.functions.symbols import SUFFIX
from tickloom.operators.ledger import GST, RATES


def _rate(kind: str) -> str:
    return "CASE instrument_type " + " ".join(f"WHEN '{n}' THEN {r[kind]:.10f}D" for n, r in RATES.items()) + " END"


def register(spark: SparkSession) -> None:
    """strip_contract(symbol), ist_tod(ts_sec) and tc_cost(price, quantity, lot_size, side, instrument_type)."""
    pattern = SUFFIX.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strip_contract(symbol STRING) RETURNS STRING "
              f"RETURN regexp_replace(symbol, '{pattern}', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ist_tod(ts_sec BIGINT) RETURNS BIGINT RETURN pmod(ts_sec + 19800, 86400)")
    value = "price * quantity * lot_size"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tc_cost(price DOUBLE, quantity BIGINT, lot_size BIGINT, side STRING, "
        f"instrument_type STRING) RETURNS DOUBLE RETURN ({_rate('brokerage')} + {value} * ({_rate('exchange')} + {_rate('sebi')})) "
        f"* {1 + GST}D + {value} * CASE side WHEN 'SELL' THEN {_rate('stt')} ELSE {_rate('stamp')} END")
