"""Option bars and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import in_session, ist_date, per_deviation, ratio
from tickloom.functions.pricing import RISK_FREE, iv_greeks
from tickloom.functions.symbols import parse_options
from tickloom.operators.bars import build_bars
from tickloom.operators.frames import span
from tickloom.operators.rolling import Frame, rolling


def option_bars(ticks: DataFrame, width: int = 1, tiebreak: str = "tick_id") -> DataFrame:
    """Bars of option ticks, grouped over the whole day."""
    b = build_bars(ticks, width, tiebreak)
    return b.select("symbol", "ts_sec", "date", "open", "high", "low", "close", "volume", "tick_count", "oi",
                    "spread_mean", "spread_max", "imbalance_mean", "imbalance_last", "total_bid_qty",
                    "total_ask_qty", "bid_p1", "ask_p1")


def spot_series(spot: DataFrame, futures: DataFrame) -> DataFrame:
    """(underlying, ts_sec, spot_price): spot ticks, or the future on days without any spot.

    Both inputs are bars with ``underlying``, ``ts_sec`` and ``close``; futures also
    have ``expiry`` and the nearest one is used.
    """
    s = spot.select("underlying", "ts_sec", F.col("close").alias("spot_price"), F.lit("spot").alias("source"))
    s = s.withColumn("date", ist_date())
    f = futures.withColumn("date", ist_date())
    near = f.groupBy("underlying", "date").agg(F.min("expiry").alias("expiry"))
    f = f.join(near, ["underlying", "date", "expiry"]).join(
        s.select("underlying", "date").distinct(), ["underlying", "date"], "left_anti")
    f = f.select("underlying", "ts_sec", F.col("close").alias("spot_price"), F.lit("future").alias("source"), "date")
    return s.unionByName(f)


def with_spot(bars: DataFrame, spot: DataFrame) -> DataFrame:
    """Spot price at each option bar: equal second, else the last before, else the first after, within the day."""
    d = bars.join(spot.select("underlying", "ts_sec", "spot_price"), ["underlying", "ts_sec"], "left")
    return fill_both_ways(d, "spot_price")


def fill_both_ways(df: DataFrame, value: str, part: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    w = Window.partitionBy(*part).orderBy("ts_sec")
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(back, ahead))


def time_to_expiry(expiry: Column, day: Column) -> Column:
    return F.greatest(F.datediff(expiry, day) / 365.0, F.lit(1 / 365.0))


def moneyness(spot: Column, strike: Column) -> Column:
    return ratio(spot - strike, spot)


def iv_windows(df: DataFrame, mean_rows: int = 60, z_rows: int = 300) -> DataFrame:
    """Full-frame mean and z-score of implied volatility by option and day."""
    s = span(df, back=z_rows + 1, blocks=True)
    d = rolling(s, s.df, {
        "iv_ma_60s": Frame("mean", "iv", mean_rows, full=True), "_m": Frame("mean", "iv", z_rows, full=True),
        "_s": Frame("std", "iv", z_rows, full=True)})
    return s.close(d.withColumn("iv_zscore", per_deviation(F.col("iv") - F.col("_m"), F.col("_s"))).drop("_m", "_s"))


def enrich_chain(bars: DataFrame, spot: DataFrame, rate: float = RISK_FREE,
                 mean_rows: int = 60, z_rows: int = 300) -> DataFrame:
    """Option bars with contract terms, spot, implied volatility, Greeks and rolling volatility."""
    d = parse_options(bars).where("underlying IS NOT NULL AND expiry IS NOT NULL")
    d = with_spot(d, spot)
    d = d.withColumns({
        "tte": time_to_expiry(F.col("expiry"), F.col("date")), "moneyness": moneyness(F.col("spot_price"), F.col("strike"))})
    g = iv_greeks(F.col("close"), F.col("spot_price"), F.col("strike"), F.col("tte"), F.col("opt_type"), rate)
    d = d.withColumn("_g", g).select("*", "_g.*").drop("_g")
    return iv_windows(d, mean_rows, z_rows)


def rejected_symbols(bars: DataFrame) -> DataFrame:
    """Symbols that end like an option but parse as neither form."""
    d = parse_options(bars.where(F.col("symbol").rlike("(CE|PE)$")))
    return d.where("underlying IS NULL OR expiry IS NULL").select("symbol").distinct()


def select_options(chain: DataFrame, opt_type: str | None = None, strikes: tuple[float, float] | None = None,
                   min_premium: float = 0.0, max_tte: float = 1.0, market_hours_only: bool = True) -> DataFrame:
    d = chain
    if market_hours_only:
        d = d.where(in_session("underlying"))
    if opt_type:
        d = d.where(F.col("opt_type") == opt_type)
    if strikes:
        d = d.where(F.col("strike").between(*strikes))
    if min_premium > 0:
        d = d.where(F.col("close") >= min_premium)
    return d.where(F.col("tte") <= max_tte) if max_tte < 1 else d


def chain_snapshots(chain: DataFrame, interval: float, each_side: int = 5, min_price: float = 0.5) -> DataFrame:
    """At every second, the strikes within ``each_side`` intervals of the strike nearest to spot."""
    atm = F.rint(F.col("spot_price") / interval) * interval
    d = chain.withColumn("atm", atm).where(F.col("close") > min_price)
    return d.where(F.abs(F.col("strike") - F.col("atm")) <= each_side * interval)


def quotable(chain: DataFrame, min_premium: float, max_premium: float, max_delta: float) -> DataFrame:
    return chain.where(
        F.col("close").between(min_premium, max_premium) & (F.abs("delta") <= max_delta) & (F.col("iv") > 0))


def with_future(chain: DataFrame, futures: DataFrame) -> DataFrame:
    """Future close at the option's second."""
    f = futures.select("underlying", "ts_sec", F.col("close").alias("future_price"))
    return chain.join(f, ["underlying", "ts_sec"], "left")


def nearest_expiries(instruments: DataFrame, as_of: str, n: int = 1) -> DataFrame:
    d = instruments.where(F.col("expiry") >= F.lit(as_of).cast("date"))
    w = Window.partitionBy("underlying").orderBy("expiry")
    return d.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).drop("_r")


def around_middle(instruments: DataFrame, interval: float, each_side: int) -> DataFrame:
    """Options on the strike grid around the middle listed strike of their expiry."""
    keys = ["underlying", "expiry"]
    s = instruments.select(*keys, "strike").distinct()
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy("strike")) - 1
    mid = s.withColumns({"_i": i, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_i") == F.floor(F.col("_n") / 2))
    mid = mid.select(*keys, (F.rint(F.col("strike") / interval) * interval).alias("atm"))
    off = F.col("strike") - F.col("atm")
    return instruments.join(mid, keys).where((F.abs(off) <= each_side * interval) & (off % interval == 0))


def quality(chain: DataFrame) -> DataFrame:
    return chain.groupBy("underlying", "date").agg(
        F.count(F.lit(1)).alias("n_bars"), F.countDistinct("symbol").alias("n_symbols"),
        F.sum(F.when((F.col("close") > 1) & (F.col("iv") > 0), 1).otherwise(0)).alias("good_bars"),
        F.avg(F.when(F.col("close") > 1, F.col("close"))).alias("avg_premium"),
        F.avg(F.when(F.col("iv") > 0, F.col("iv"))).alias("avg_iv"), F.avg(F.abs("delta")).alias("avg_abs_delta"),
        F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"))


def strike_sets(spot: DataFrame, master: DataFrame, interval: float, each_side: int, slot_seconds: int = 1800,
                min_shift: int = 2) -> DataFrame:
    """Strikes to add and remove when the nearest strike moved, per slot.

    ``spot`` has (underlying, ts_sec, spot_price); the last price of a slot counts. The
    move is measured from the strike of the last change, and a day starts without
    one. A day has at most 86400 / slot_seconds slots, so they fold in one small array.
    """
    slot = (F.floor(F.col("ts_sec") / slot_seconds) * slot_seconds).cast("long")
    s = spot.withColumn("slot", slot).groupBy("underlying", "slot").agg(
        F.max_by("spot_price", "ts_sec").alias("price"))
    s = s.withColumns({"atm": F.rint(F.col("price") / interval) * interval, "date": ist_date("slot")})
    day = s.groupBy("underlying", "date").agg(
        F.array_sort(F.collect_list(F.struct("slot", "atm"))).alias("_slots"))
    kept = F.aggregate(
        "_slots", F.slice("_slots", 1, 1),
        lambda acc, x: F.when(
            F.abs(x["atm"] - F.element_at(acc, -1)["atm"]) / interval >= min_shift, F.concat(acc, F.array(x)),
        ).otherwise(acc))
    s = day.select("underlying", "date", F.explode(kept).alias("_s")).select("underlying", "date", "_s.*")
    listed = master.groupBy("underlying").agg(F.array_sort(F.collect_set("strike")).alias("_all"))
    s = s.join(listed, "underlying").withColumn(
        "strikes", F.filter("_all", lambda k: F.abs(k - F.col("atm")) <= each_side * interval))
    w = Window.partitionBy("underlying", "date").orderBy("slot")
    s = s.withColumns({
        "old_atm": F.lag("atm").over(w), "_prev": F.coalesce(F.lag("strikes").over(w), F.array().cast("array<double>"))})
    return s.withColumns({
        "to_add": F.array_except("strikes", "_prev"), "to_remove": F.array_except("_prev", "strikes")}).drop("_prev", "_all")
