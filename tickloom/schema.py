"""Declared table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ATOMS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
          "DATE": T.DateType(), "BOOLEAN": T.BooleanType(), "STRINGS": T.ArrayType(T.StringType())}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """Schema from "name TYPE, ..."; names given as keywords have the nested type passed for them."""
    fields = []
    for part in text.split(", "):
        name, _, kind = part.partition(" ")
        fields.append(T.StructField(name, nested[name] if name in nested else _ATOMS[kind]))
    return T.StructType(fields)


_SIDES = [(s, i) for s in ("bid", "ask") for i in range(1, 6)]
_LEVELS = T.ArrayType(_struct("price DOUBLE, quantity BIGINT, orders BIGINT"))

TICK = _struct(
    "ts_local_ns BIGINT, ts_exchange STRING, ts_trade STRING, symbol STRING, instrument_token STRING, "
    "last_price DOUBLE, last_qty BIGINT, avg_price DOUBLE, volume BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, "
    "close DOUBLE, oi BIGINT, oi_day_high BIGINT, oi_day_low BIGINT, total_bid_qty BIGINT, total_ask_qty BIGINT, "
    "mid_price DOUBLE, spread DOUBLE, book_imbalance DOUBLE, "
    + ", ".join(f"{s}_p{i} DOUBLE, {s}_q{i} BIGINT, {s}_o{i} BIGINT" for s, i in _SIDES))

RAW_TICK = _struct(
    "ts_local_ns BIGINT, exchange_timestamp STRING, last_trade_time STRING, symbol STRING, instrument_token STRING, "
    "last_price DOUBLE, last_traded_quantity BIGINT, average_traded_price DOUBLE, volume_traded BIGINT, ohlc, "
    "oi BIGINT, oi_day_high BIGINT, oi_day_low BIGINT, total_buy_quantity BIGINT, total_sell_quantity BIGINT, depth",
    ohlc=_struct("open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"),
    depth=_struct("buy, sell", buy=_LEVELS, sell=_LEVELS))

INSTRUMENT = _struct(
    "tradingsymbol STRING, name STRING, instrument_token BIGINT, instrument_type STRING, exchange STRING, "
    "expiry DATE, strike DOUBLE, lot_size INT")
FILL = _struct(
    "symbol STRING, ts_sec BIGINT, order_id BIGINT, side STRING, price DOUBLE, quantity INT, lot_size INT, "
    "instrument_type STRING")
RESULT = _struct(
    "symbol STRING, date DATE, gamma DOUBLE, kappa DOUBLE, min_spread DOUBLE, open_mult DOUBLE, net_pnl DOUBLE, "
    "sharpe DOUBLE, win_rate DOUBLE, max_dd DOUBLE, fills INT")
NEWS = _struct(
    "id STRING, source STRING, headline STRING, body STRING, url STRING, published STRING, fetched_at STRING, "
    "symbols STRINGS, scored BOOLEAN, event_type STRING, sentiment DOUBLE, uncertainty DOUBLE, "
    "price_impact STRING, informed_flow_risk STRING, mm_action STRING, widen_factor DOUBLE, pause_minutes INT, "
    "llm_symbols STRINGS")
EVENT = _struct(
    "symbol STRING, event_type STRING, event_date DATE, description STRING, source STRING, confirmed BOOLEAN")
_VALUES = T.ArrayType(_struct("value STRING"))
_SECTION = _struct("rows", rows=T.ArrayType(_struct("title STRING, columns", columns=_VALUES)))
FUNDAMENTALS_JSON = _struct(
    "ratios, profit_loss, cash_flows, shareholding",
    ratios=T.ArrayType(_struct("name STRING, values", values=_VALUES)),
    profit_loss=_SECTION, cash_flows=_SECTION, shareholding=_SECTION)


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds missing columns and fills NULLs of present ones with the given defaults."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Projects a table to a schema; absent columns become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
