"""Broker messages to flat ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import TICK, conform


def _derived(bid: Column, ask: Column, tb: Column, ta: Column) -> dict[str, Column]:
    both = (bid != 0) & (ask != 0)
    total = tb + ta
    return {
        "mid_price": F.round(F.when(both, (bid + ask) / 2).otherwise(0.0), 2),
        "spread": F.round(F.when(both, ask - bid).otherwise(0.0), 2),
        "book_imbalance": F.round(F.coalesce((tb - ta) / F.when(total != 0, total), F.lit(0.0)), 6),
    }


def _level(side: str, i: int, field: str) -> Column:
    return F.coalesce(F.get(F.col(f"depth.{side}"), F.lit(i - 1))[field], F.lit(0))


def flatten_depth(raw: DataFrame) -> DataFrame:
    """Nested five-level book to columns; missing levels and fields become 0."""
    def num(c):
        return F.coalesce(F.col(c), F.lit(0))

    cols = {}
    for out, side in (("bid", "buy"), ("ask", "sell")):
        for i in range(1, 6):
            for k, field in (("p", "price"), ("q", "quantity"), ("o", "orders")):
                cols[f"{out}_{k}{i}"] = _level(side, i, field)
    d = raw.withColumns({
        "ts_exchange": F.coalesce("exchange_timestamp", F.lit("")),
        "ts_trade": F.coalesce("last_trade_time", F.lit("")),
        "last_price": num("last_price"), "last_qty": num("last_traded_quantity"),
        "avg_price": num("average_traded_price"), "volume": num("volume_traded"),
        **{c: num(f"ohlc.{c}") for c in ("open", "high", "low", "close")},
        "oi": num("oi"), "oi_day_high": num("oi_day_high"), "oi_day_low": num("oi_day_low"),
        "total_bid_qty": num("total_buy_quantity"), "total_ask_qty": num("total_sell_quantity"), **cols})
    d = d.withColumns(_derived(F.col("bid_p1"), F.col("ask_p1"), F.col("total_bid_qty"), F.col("total_ask_qty")))
    return conform(d, TICK)


def parse_text_levels(raw: DataFrame, levels: int = 10) -> DataFrame:
    """Second feed: text columns bp1.., bq1.., sp1.., sq1..; text that is no number becomes 0."""
    def num(c, kind="double"):
        return F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind))

    cols = {}
    for out, side in (("bid", "b"), ("ask", "s")):
        for i in range(1, levels + 1):
            cols[f"{out}_p{i}"] = num(f"{side}p{i}")
            cols[f"{out}_q{i}"] = num(f"{side}q{i}", "bigint")
    d = raw.withColumns(cols).withColumns({
        "last_price": num("lp"), "volume": num("v", "bigint"),
        "total_bid_qty": sum((F.col(f"bid_q{i}") for i in range(1, levels + 1)), F.lit(0)),
        "total_ask_qty": sum((F.col(f"ask_q{i}") for i in range(1, levels + 1)), F.lit(0))})
    d = d.withColumns(_derived(F.col("bid_p1"), F.col("ask_p1"), F.col("total_bid_qty"), F.col("total_ask_qty")))
    return d.drop(*[f"{s}{k}{i}" for s in "bs" for k in "pq" for i in range(1, levels + 1)], "lp", "v")


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ticks of both feeds; columns one feed lacks are NULL."""
    return first.unionByName(second, allowMissingColumns=True)
