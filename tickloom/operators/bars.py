"""Ticks to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ist_date, ist_text, ist_tod, ratio, weighted_mid

LEVELS = range(1, 6)
LADDER = [f"{s}_{k}{i}" for s in ("bid", "ask") for i in LEVELS for k in ("p", "q")]


def tick_columns(ticks: DataFrame, width: int = 1) -> DataFrame:
    """Keeps priced ticks and adds the columns derived from one tick."""
    sec = F.floor(F.col("ts_local_ns") / 1_000_000_000).cast("long")
    return ticks.where(F.col("last_price") > 0).withColumns({
        "ts_sec": (F.floor(sec / width) * width).cast("long"),
        "weighted_mid": weighted_mid(),
        "price_impact": F.abs(F.col("last_price") - F.col("mid_price")),
        "spread_bps": ratio("spread", "mid_price") * 10000,
    })


def filled_tick_columns(ticks: DataFrame, width: int = 1) -> DataFrame:
    """The same columns with fallbacks: spread_bps 0, weighted_mid the mid price."""
    t = tick_columns(ticks, width)
    return t.withColumns({
        "spread_bps": F.coalesce(F.col("spread_bps"), F.lit(0.0)),
        "weighted_mid": F.coalesce(F.col("weighted_mid"), F.col("mid_price")),
    })


def bar_aggregates(tiebreak: str, ladder: bool = True) -> list:
    """First and last values follow (ts_local_ns, tiebreak): one pair of structs per bar."""
    order = F.struct("ts_local_ns", tiebreak)
    last = ["last_price", "volume", "avg_price", "oi", "book_imbalance",
            "total_bid_qty", "total_ask_qty", "weighted_mid"] + (LADDER if ladder else [])
    return [
        F.min_by(F.struct("last_price", "volume"), order).alias("_f"),
        F.max_by(F.struct(*last), order).alias("_l"),
        F.max("last_price").alias("high"),
        F.min("last_price").alias("low"),
        F.count(F.lit(1)).alias("tick_count"),
        F.avg("spread").alias("spread_mean"),
        F.max("spread").alias("spread_max"),
        F.avg("spread_bps").alias("spread_bps"),
        F.avg("book_imbalance").alias("imbalance_mean"),
        F.stddev_samp("book_imbalance").alias("imbalance_std"),
        F.avg("price_impact").alias("price_impact"),
    ]


def bar_columns(ladder: bool = True) -> list:
    l = F.col
    cols = [
        l("_f.last_price").alias("open"), l("high"), l("low"), l("_l.last_price").alias("close"),
        (l("_l.volume") - l("_f.volume")).alias("volume_delta"),
        l("_l.volume").alias("volume_cumulative"), l("_l.volume").alias("volume"),
        l("tick_count"), l("_l.avg_price").alias("vwap"), l("_l.oi").alias("oi"),
        l("spread_mean"), l("spread_max"), l("spread_bps"),
        l("imbalance_mean"), l("imbalance_std"), l("_l.book_imbalance").alias("imbalance_last"),
        l("_l.total_bid_qty").alias("total_bid_qty"), l("_l.total_ask_qty").alias("total_ask_qty"),
        l("_l.weighted_mid").alias("weighted_mid"), l("price_impact"),
    ]
    return cols + ([l(f"_l.{c}").alias(c) for c in LADDER] if ladder else [])


def build_bars(ticks: DataFrame, width: int = 1, tiebreak: str = "tick_id",
               ladder: bool = True) -> DataFrame:
    """OHLC bars of every symbol in one aggregation; combines on the map side."""
    g = tick_columns(ticks, width).groupBy("symbol", "ts_sec").agg(*bar_aggregates(tiebreak, ladder))
    return g.select("symbol", "ts_sec", *bar_columns(ladder)).withColumns({
        "date": ist_date(), "ist_tod": ist_tod().cast("int"), "ts_ist": ist_text(),
    })


def resample_last(bars: DataFrame, width: int = 60, value: str = "close") -> DataFrame:
    """Coarser series that keeps the last value of every interval."""
    slot = (F.floor(F.col("ts_sec") / width) * width).cast("long")
    return (
        bars.withColumn("_slot", slot).groupBy("symbol", "_slot")
        .agg(F.max_by(value, "ts_sec").alias(value))
        .withColumnRenamed("_slot", "ts_sec")
        .withColumn("date", ist_date())
    )


def distinct_timestamps(bars: DataFrame, tiebreak: str) -> DataFrame:
    """One row per (symbol, ts_sec); the smallest ``tiebreak`` wins."""
    w = Window.partitionBy("symbol", "ts_sec").orderBy(tiebreak)
    return bars.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
