"""Parameter sets: lookup, blending, health, contract-roll transfer, and ranking of result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, ratio
from tickloom.functions.symbols import contract_month, strip_contract
from tickloom.operators.frames import span, with_position
from tickloom.operators.ranks import trim_between
from tickloom.session import stage

# Sane range of each parameter.
BOUNDS = {
    "gamma": (1e-6, 0.1), "kappa": (0.1, 10.0), "min_spread": (0.01, 5.0), "open_mult": (0.5, 5.0),
    "phi": (1e-6, 0.1), "rho": (0.05, 0.95), "zeta": (0.05, 5.0), "beta": (0.1, 10.0), "theta": (0.1, 10.0),
    "eta": (0.01, 2.0), "nu": (0.01, 2.0), "theta_kappa": (0.1, 5.0),
}
# How far a transfer may move a parameter.
TRANSFER = {
    "spread_width": (0.5, 2.5), "gamma": (0.5, 2.5), "kappa": (0.6, 1.8), "min_spread": (0.5, 3.0), "open_mult": (0.8, 1.5),
}
WITH_VOL = ("gamma", "min_spread", "spread_width", "alpha", "sigma", "vol_mult")


def _lookup(key: Column, table: dict[str, tuple[float, float]], i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[key]


def as_maps(rows: DataFrame) -> DataFrame:
    """(symbol, key, value) rows to one map per symbol."""
    return rows.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))


def resolve(symbols: DataFrame, params: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Parameters of each symbol: exact, else the latest contract of the same base, else the defaults."""
    p = params.withColumn("base", strip_contract("symbol"))
    w = Window.partitionBy("base").orderBy(F.desc_nulls_last(contract_month("symbol")), F.desc("symbol"))
    by_base = p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "base", F.col("symbol").alias("base_symbol"), F.col("params").alias("_pb"))
    fixed = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, float(v))])
    d = symbols.select("symbol").distinct().withColumn("base", strip_contract("symbol"))
    d = d.join(params.select("symbol", F.col("params").alias("_pe")), "symbol", "left").join(by_base, "base", "left")
    found = F.coalesce("_pe", "_pb", fixed)
    return d.select(
        "symbol", F.when(F.col("_pe").isNotNull(), "exact").when(F.col("_pb").isNotNull(), "base").otherwise("default").alias("layer"),
        F.when(F.col("_pe").isNull(), F.col("base_symbol")).alias("base_symbol"),
        *[F.coalesce(found[k], F.lit(float(v))).alias(k) for k, v in defaults.items()])


def blend(old: DataFrame, new: DataFrame, alpha: float = 0.4) -> DataFrame:
    """(1 - alpha) old + alpha new per (symbol, key); what only one side has is kept."""
    d = old.withColumnRenamed("value", "_o").join(new.withColumnRenamed("value", "_n"), ["symbol", "key"], "full_outer")
    mixed = F.round((1 - alpha) * F.col("_o") + alpha * F.col("_n"), 6)
    return d.select("symbol", "key", F.coalesce(mixed, "_n", "_o").alias("value"))


def health_issues(rows: DataFrame, required: tuple[str, ...] = ("min_spread",)) -> DataFrame:
    """One row per problem: missing key, value outside its range, value that is no number."""
    v, k = F.col("value"), F.col("key")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    lo, hi = _lookup(k, BOUNDS, 0), _lookup(k, BOUNDS, 1)
    issue = F.when(bad, "not a number").when((v < lo) | (v > hi), "out of range")
    found = rows.withColumn("issue", issue).where("issue IS NOT NULL").select("symbol", "key", "issue")
    for r in required:
        none = rows.groupBy("symbol").agg(F.max(k == r).alias("_has")).where("NOT _has")
        found = found.unionByName(none.select("symbol", F.lit(r).alias("key"), F.lit("missing").alias("issue")))
    return found


def health(rows: DataFrame, as_of: str, updated: str, min_symbols: int = 50, max_age_days: int = 3) -> DataFrame:
    """Coverage, number of problems, age and verdict of a parameter set, in one row."""
    n = rows.agg(F.countDistinct("symbol").alias("n_symbols"))
    i = health_issues(rows).agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("symbol").alias("n_bad_symbols"))
    age = F.datediff(F.lit(as_of).cast("date"), F.lit(updated).cast("date"))
    d = n.withColumn("_k", F.lit(1)).join(F.broadcast(i.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn("age_days", age)
    critical = (F.col("n_symbols") < min_symbols) | (F.col("age_days") > max_age_days)
    return d.withColumn("status", F.when(critical, "CRITICAL").when(F.col("n_issues") > 0, "WARNING").otherwise("OK"))


# ---- contract roll ------------------------------------------------------------------

def edge_days(prices: DataFrame, n: int, last: bool) -> DataFrame:
    """Rows of the last (or first) n days of every symbol."""
    days = prices.select("symbol", "date").distinct()
    w = Window.partitionBy("symbol").orderBy(F.desc("date") if last else F.asc("date"))
    days = days.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return prices.join(days, ["symbol", "date"], "left_semi")


def terminal_volatility(prices: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Last value of the exponentially weighted deviation of trimmed log returns, annualised."""
    n = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    s = span(prices, True, back=1)
    d = s.close(s.df.withColumn("r", F.log(F.col("price") + 1e-10) - F.log(s.lag("price") + 1e-10)))
    d = stage(d.where("r IS NOT NULL").select("symbol", "date", "ts_sec", "r"), "returns")
    d = stage(trim_between(d, ["symbol"], "r", 0.01, 0.99), "trimmed")
    d = with_position(d, ["symbol"], "date", ["ts_sec"])
    end = d.groupBy("symbol").agg(F.max("_pos").alias("_end"), F.avg("r").alias("_c"))
    d = d.join(end, "symbol")
    w = F.pow(F.lit(1 - alpha), (F.col("_end") - F.col("_pos")).cast("double"))
    x = F.col("r") - F.col("_c")
    g = d.groupBy("symbol").agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("m"), F.sum(w * x * x).alias("q"),
        F.count(F.lit(1)).alias("k")).where("k >= 10")
    var = (F.col("q") / F.col("w") - F.pow(F.col("m") / F.col("w"), 2.0)) * F.col("w") * F.col("w") / (
        F.col("w") * F.col("w") - F.col("w2"))
    return g.select("symbol", (F.sqrt(F.greatest(var, F.lit(0.0))) * math.sqrt(23400 * 252)).alias("vol")).join(n, "symbol")


def edge_price(prices: DataFrame, rows: int, last: bool) -> DataFrame:
    """Median of the last (or first) rows of the symbol's last (or first) day, at most ``rows`` of them."""
    d = edge_days(prices, 1, last)
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_sec") if last else F.asc("ts_sec"))
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    return d.groupBy("symbol").agg(F.median("price").alias("price"))


def roll_ratios(prices: DataFrame, rolls: DataFrame, old_days: int = 3, new_days: int = 2, min_rows: int = 500) -> DataFrame:
    """Volatility and price ratios per (old_symbol, new_symbol); 1 where either side has too few rows."""
    sides = ("old", "new")
    edges = [
        edge_days(prices.join(rolls.select(F.col(f"{x}_symbol").alias("symbol")), "symbol", "left_semi"), n, x == "old")
        .withColumn("symbol", F.concat_ws("|", F.lit(x), F.col("symbol"))) for x, n in zip(sides, (old_days, new_days))]
    vol = stage(terminal_volatility(edges[0].unionByName(edges[1])), "roll-volatility")
    ov, nv = (vol.where(F.col("symbol").startswith(f"{x}|")).withColumn("symbol", F.substring_index("symbol", "|", -1)) for x in sides)
    op, np_ = edge_price(prices, 100, True), edge_price(prices, 100, False)

    def side(t, prefix, value):
        return t.select(F.col("symbol").alias(f"{prefix}_symbol"), *[F.col(c).alias(f"{prefix}_{c}") for c in value])

    d = rolls.join(side(ov, "old", ["vol", "n_rows"]), "old_symbol", "left").join(side(nv, "new", ["vol", "n_rows"]), "new_symbol", "left")
    d = d.join(side(op, "old", ["price"]), "old_symbol", "left").join(side(np_, "new", ["price"]), "new_symbol", "left")
    enough = (F.col("old_n_rows") >= min_rows) & (F.col("new_n_rows") >= min_rows) & (F.col("old_vol") >= 1e-8) & (F.col("new_vol") >= 1e-8)
    return d.select(
        "old_symbol", "new_symbol", "old_vol", "new_vol",
        F.when(enough, clip(F.col("new_vol") / F.when(enough, F.col("old_vol")), 0.5, 2.0)).otherwise(1.0).alias("vol_ratio"),
        F.coalesce(clip(ratio("new_price", F.when(F.col("old_price") >= 1e-8, F.col("old_price"))), 0.7, 1.3), F.lit(1.0)).alias("price_ratio"))


def transfer(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """Parameters of the new contract, scaled by the volatility ratio and kept within bounds.

    A symbol whose result fails validation (key missing, not positive, or moved by
    less than 0.4 or more than 3) keeps its old values.
    """
    v, k, r = F.col("value"), F.col("key"), F.col("vol_ratio")
    scale = F.when(k.isin(*WITH_VOL), r).when(k == "kappa", F.sqrt(r)).when(k == "open_mult", 1 + (r - 1) * 0.3).otherwise(1.0)
    lo, hi = _lookup(k, TRANSFER, 0), _lookup(k, TRANSFER, 1)
    d = rows.join(ratios.select(F.col("old_symbol").alias("symbol"), "new_symbol", "vol_ratio"), "symbol")
    d = d.withColumn("_new", v * scale)
    d = d.withColumn("_new", F.when(lo.isNull(), F.col("_new")).otherwise(
        F.greatest(F.least(F.col("_new"), F.greatest(v * lo, v * hi)), F.least(v * lo, v * hi))))
    need = k.isin("gamma", "kappa", "min_spread")
    moved = F.col("_new") / F.when(v > 0, v)
    wrong = need & ((F.col("_new") <= 0) | (F.coalesce(moved, F.lit(1.0)) < 0.4) | (F.coalesce(moved, F.lit(1.0)) > 3.0))
    ok = d.groupBy("symbol").agg((F.sum(need.cast("int")) == 3).alias("_all"), F.max(wrong).alias("_wrong"))
    d = d.join(ok, "symbol").withColumn("is_valid", F.col("_all") & ~F.col("_wrong"))
    return d.select("symbol", "new_symbol", "key", F.col("value").alias("old_value"),
                    F.when(F.col("is_valid"), F.col("_new")).otherwise(v).alias("value"), "is_valid")


# ---- result rows ---------------------------------------------------------------------

def walk_forward(results: DataFrame, params: list[str], train_sharpe: str = "mean") -> DataFrame:
    """Train on all days before, test on the next day, per symbol and parameter combination.

    ``train_sharpe``: "mean" averages the daily values; "pnl" uses mean over deviation of
    the daily results, annualised.
    """
    keys = ["symbol", *params]
    day = Window.partitionBy(*keys).orderBy("date")
    before = day.rowsBetween(Window.unboundedPreceding, -1)
    if train_sharpe == "mean":
        ts = F.avg("sharpe").over(before)
    else:
        sd = F.stddev_pop("net_pnl").over(before)
        ts = F.when(F.count(F.lit(1)).over(before) > 0, F.coalesce(
            F.avg("net_pnl").over(before) / F.when(sd > 1e-12, sd) * math.sqrt(252), F.lit(0.0)))
    d = results.withColumns({"_ts": ts, "_tp": F.sum("net_pnl").over(before), "_i": F.row_number().over(day)})
    test = F.col("_i") > 1
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_ts").alias("_ats"), F.avg("_tp").alias("_atp"),
        F.avg(F.when(test, F.col("sharpe"))).alias("_tsh"), F.sum(F.when(test, F.col("net_pnl"))).alias("_tpn"),
        F.avg("sharpe").alias("_s1"), F.sum("net_pnl").alias("total_pnl"), F.avg("net_pnl").alias("avg_daily_pnl"),
        F.sum((F.col("net_pnl") > 0).cast("int")).alias("profitable_days"), F.stddev_pop("net_pnl").alias("pnl_std"))
    one = F.col("_n") < 2
    return g.select(
        *keys, F.when(one, F.col("_s1")).otherwise(F.col("_ats")).alias("train_sharpe"),
        F.when(one, F.col("total_pnl")).otherwise(F.col("_atp")).alias("train_pnl"),
        F.when(one, F.col("_s1")).otherwise(F.col("_tsh")).alias("test_sharpe"),
        F.when(one, F.col("total_pnl")).otherwise(F.col("_tpn")).alias("test_pnl"),
        F.when(one, F.col("_n")).otherwise(F.col("_n") - 1).alias("test_days"),
        "total_pnl", "avg_daily_pnl", "profitable_days", "pnl_std")


def best_params(scores: DataFrame, params: list[str]) -> DataFrame:
    """Best combination per symbol among those that earn out of sample, else the best in training."""
    good = (F.col("test_days") > 0) & (F.col("test_pnl") > 0)
    rank = F.when(good, F.col("test_sharpe") * F.col("profitable_days") / F.col("test_days"))
    d = scores.withColumns({"rank_score": rank, "_alt": F.when(rank.isNull(), F.col("train_sharpe"))})
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("rank_score"), F.desc("_alt"), *params)
    d = d.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return d.withColumns({"fallback": F.col("rank_score").isNull(), "rank_score": F.coalesce("rank_score", F.lit(0.0))}).drop("_r", "_alt")


def combo_stats(results: DataFrame, params: list[str]) -> DataFrame:
    """Statistics of the daily total over all symbols, per combination."""
    day = results.groupBy(*params, "date").agg(
        F.sum("net_pnl").alias("p"), F.count(F.lit(1)).alias("n"), F.sum((F.col("net_pnl") > 0).cast("int")).alias("k"))
    sd = F.stddev_samp("p")
    return day.groupBy(*params).agg(
        F.avg("p").alias("mean_daily_pnl"), sd.alias("std_daily_pnl"),
        F.coalesce(F.avg("p") / F.when(sd > 1e-12, sd), F.lit(0.0)).alias("sharpe"),
        (F.avg((F.col("p") > 0).cast("int")) * 100).alias("pct_profit_days"),
        (F.sum("k") / F.sum("n") * 100).alias("pct_symbol_profit"), F.min("p").alias("min_daily_pnl"),
        F.max("p").alias("max_daily_pnl"), F.sum("n").alias("n_valid"))


def best_consistent(results: DataFrame, params: list[str], min_profit: float = 66.0) -> DataFrame:
    """Highest Sharpe per symbol among combinations profitable often enough; all of them where none is."""
    g = results.groupBy("symbol", *params).agg(
        F.avg("net_pnl").alias("mean_pnl"), F.stddev_samp("net_pnl").alias("std_pnl"),
        (F.avg((F.col("net_pnl") > 0).cast("int")) * 100).alias("pct_profit"))
    g = g.withColumn("sharpe", F.col("mean_pnl") / F.greatest(F.col("std_pnl"), F.lit(1.0)))
    w = Window.partitionBy("symbol").orderBy((F.col("pct_profit") >= min_profit).desc(), F.desc_nulls_last("sharpe"), *params)
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def compare_models(first: DataFrame, second: DataFrame) -> DataFrame:
    """Result per base symbol under two models and the model to route it to."""
    def per_base(df, name):
        return df.groupBy(strip_contract("symbol").alias("base")).agg(F.sum("net_pnl").alias(name))

    d = per_base(first, "pnl_1").join(per_base(second, "pnl_2"), "base", "full_outer")
    one = F.col("pnl_2").isNull() | (F.col("pnl_1") >= F.col("pnl_2"))
    return d.withColumns({
        "route": F.when(one, "V1").otherwise("V2"), "best": F.when(one, F.col("pnl_1")).otherwise(F.col("pnl_2")),
    }).withColumn("hybrid", F.greatest("best", F.lit(0.0)))


def comparison_totals(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.sum("pnl_1").alias("total_1"), F.sum("pnl_2").alias("total_2"), F.sum("hybrid").alias("hybrid_total"),
        F.sum((F.col("route") == "V1").cast("int")).alias("n_route_1"), F.sum((F.col("route") == "V2").cast("int")).alias("n_route_2"))


def compare_sharpe(base: DataFrame, other: DataFrame) -> DataFrame:
    """Change of Sharpe per symbol in percent, and a verdict."""
    d = base.select("symbol", F.col("sharpe").alias("sharpe_base")).join(
        other.select("symbol", F.col("sharpe").alias("sharpe_other")), "symbol")
    pct = (F.col("sharpe_other") - F.col("sharpe_base")) / F.greatest(F.abs("sharpe_base"), F.lit(0.1)) * 100
    d = d.withColumn("improvement_pct", pct)
    p = F.col("improvement_pct")
    return d.withColumn("verdict", F.when(p > 5, "IMPROVE").when(F.abs(p) <= 5, "neutral").otherwise("worse"))
