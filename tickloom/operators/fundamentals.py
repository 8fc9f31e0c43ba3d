"""Company snapshots from nested JSON, and the quality signals built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import pearson
from tickloom.schema import FUNDAMENTALS_JSON


def number(text: Column) -> Column:
    """1,234 and 12% as numbers; other text is NULL."""
    return F.regexp_replace(text, "[,%]", "").try_cast("double")


def _ratio(name: str) -> Column:
    """Last present value of the first ratio whose name contains ``name``."""
    found = F.filter("doc.ratios", lambda r: F.contains(F.lower(r["name"]), F.lit(name.lower())))
    values = F.filter(F.get(found, F.lit(0))["values"], lambda v: v["value"].isNotNull())
    return number(F.get(values, F.size(values) - 1)["value"])


def _row(section: str, *titles: str, without: str | None = None, last: bool = True) -> Column:
    """Numbers of the matching row of a section, as an array; the last match unless told otherwise."""
    def hit(r):
        t = F.upper(r["title"])
        ok = F.lit(False)
        for x in titles:
            ok = ok | F.contains(t, F.lit(x))
        return ok if without is None else ok & ~F.contains(t, F.lit(without))

    rows = F.filter(f"doc.{section}.rows", hit)
    row = F.get(rows, F.size(rows) - 1) if last else F.get(rows, F.lit(0))
    return F.filter(F.transform(row["columns"], lambda c: number(c["value"])), lambda x: x.isNotNull())


def cagr3(values: Column) -> Column:
    """Three-year growth in percent from the last and the fourth-last value."""
    n = F.size(values)
    new, old = F.get(values, n - 1), F.get(values, n - 4)
    base = new / F.when(old != 0, old)
    return F.when((n >= 4) & (base > 0), F.round((F.pow(base, 1 / 3) - 1) * 100, 1))


def last3_std(values: Column) -> Column:
    n = F.size(values)
    a, b, c = (F.get(values, n - i) for i in (1, 2, 3))
    m = (a + b + c) / 3
    return F.when(n >= 3, F.sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 2))


def snapshot(docs: DataFrame, json: str = "json") -> DataFrame:
    """One wide row per symbol from its JSON document."""
    d = docs.withColumn("doc", F.from_json(json, FUNDAMENTALS_JSON))
    d = d.withColumns({
        "market_cap": _ratio("Market Cap"), "pe_ratio": _ratio("Price to Earning"), "pb_ratio": _ratio("Price to Book"),
        "dividend_yield": _ratio("Dividend Yield"), "roe": _ratio("Return on Equity"), "roce": _ratio("Return on Capital"),
        "operating_margin": _ratio("OPM"), "debt_equity": _ratio("Debt to Equity"),
        "interest_coverage": _ratio("Interest Coverage"), "current_ratio": _ratio("Current Ratio"),
        "_npm": _ratio("Net Profit Margin"), "_rev": _row("profit_loss", "SALES", "REVENUE"),
        "_pat": _row("profit_loss", "NET PROFIT", "PAT"), "_cfo": _row("cash_flows", "OPERATING ACTIVIT", last=False),
        "_prom": _row("shareholding", "PROMOTER", without="PLEDG"), "_pledge": _row("shareholding", "PLEDG")})
    cfo = F.slice("_cfo", F.greatest(F.lit(1), F.size("_cfo") - 3), F.lit(4))
    pat = F.get("_pat", F.size("_pat") - 1)
    mean_cfo = F.aggregate(cfo, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(cfo) > 0, F.size(cfo))
    d = d.withColumns({
        "pat_margin": F.coalesce(F.when(F.col("_npm") != 0, F.col("_npm")), "operating_margin"),
        "revenue_growth_3yr": cagr3(F.col("_rev")), "pat_growth_3yr": cagr3(F.col("_pat")), "pat_std_3yr": last3_std(F.col("_pat")),
        "cash_flow_pat_ratio": mean_cfo / F.when(pat != 0, pat),
        "promoter_holding": F.get("_prom", F.size("_prom") - 1), "promoter_pledging": F.get("_pledge", F.size("_pledge") - 1)})
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("pe_ratio", "roe", "debt_equity", "promoter_holding", "pat_growth_3yr")), F.lit(0))
    grade = F.when(filled >= 4, "GOOD").when(filled >= 2, "PARTIAL").otherwise("MISSING")
    return d.withColumn("data_quality", grade).drop("doc", json, "_npm", "_rev", "_pat", "_cfo", "_prom", "_pledge")


def _ladder(x: Column, steps, below: bool = False) -> Column:
    out = F.lit(0)
    for limit, points in reversed(steps):
        out = F.when(x < limit if below else x > limit, points).otherwise(out)
    return out


def quality_score(df: DataFrame) -> DataFrame:
    """Score 0-100 from profitability, growth, balance sheet, earnings quality and penalties."""
    def c(name, default=0.0):
        return F.coalesce(F.col(name), F.lit(default))

    cash = c("free_cash_flow") / F.greatest(F.abs(c("net_profit", 1.0)), F.lit(1.0))
    score = (
        _ladder(c("roe"), ((20, 10), (15, 7), (10, 4))) + _ladder(c("roce"), ((15, 10), (12, 7), (8, 4)))
        + _ladder(c("net_profit_margin"), ((15, 10), (8, 7), (4, 4)))
        + _ladder(c("revenue_growth"), ((20, 10), (10, 7), (5, 4))) + _ladder(c("eps_growth"), ((25, 15), (15, 10), (5, 5)))
        + _ladder(c("debt_equity", 999.0), ((0.3, 15), (0.7, 10), (1.0, 5), (2.0, 2)), below=True)
        + _ladder(c("current_ratio"), ((2.0, 10), (1.5, 7), (1.0, 4)))
        + _ladder(cash, ((0.9, 10), (0.7, 7), (0.5, 4)))
        + _ladder(c("promoter_holding"), ((60, 10), (50, 7), (40, 4)))
        - _ladder(c("promoter_pledging"), ((50, 20), (30, 10), (10, 5)))
        - F.when(F.coalesce(F.col("audit_qualification"), F.lit(False)), 15).otherwise(0))
    return df.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double"))))


def recommendation(df: DataFrame) -> DataFrame:
    """Recommendation and spread multiplier; the first rule that holds decides."""
    q, days, pledge = F.col("quality"), F.col("days_to_earnings"), F.coalesce(F.col("promoter_pledging"), F.lit(0.0))
    debt, audit = F.col("debt_equity") > 2.0, F.coalesce(F.col("audit_qualification"), F.lit(False))

    def r(name, m):
        return F.struct(F.lit(name).alias("recommendation"), F.lit(m).alias("spread_multiplier"))

    rule = (
        F.when(audit | (pledge > 50) | (debt & (q < 30)), r("avoid", 0.0))
        .when(days <= 1, r("cautious", 2.0)).when(days <= 3, r("cautious", 1.7)).when(days <= 7, r("cautious", 1.3))
        .when((q >= 70) & debt, r("normal", 1.0)).when(q >= 70, r("aggressive", 0.85)).when(q >= 50, r("normal", 1.0))
        .when(q >= 30, r("cautious", 1.2)).when(pledge > 30, r("cautious", 1.5)).otherwise(r("cautious", 1.3)))
    return df.withColumn("_r", rule).select("*", "_r.*").drop("_r")


def earnings_surprise(history: DataFrame, quarters: int = 8) -> DataFrame:
    """Beat rate, mean surprise, trend and alpha prior from the last quarters. ``history``: symbol, quarter, eps_estimate, eps_actual."""
    w = Window.partitionBy("symbol").orderBy(F.desc("quarter"))
    d = history.withColumn("_q", F.row_number().over(w)).where(F.col("_q") <= quarters).where("eps_estimate <> 0")
    d = d.withColumn("s", (F.col("eps_actual") - F.col("eps_estimate")) / F.abs("eps_estimate") * 100)
    d = d.withColumn("_k", F.row_number().over(w))
    k = F.col("_k")
    g = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("s") > 0).cast("int")).alias("beat_rate"), F.avg("s").alias("avg_surprise_pct"),
        F.avg(F.when(k <= 2, F.col("s"))).alias("_new"), F.avg(F.when(k.between(3, 4), F.col("s"))).alias("_old"))
    trend = F.when((F.col("n") >= 4) & (F.col("_new") > F.col("_old") + 2), "improving").when(
        (F.col("n") >= 4) & (F.col("_new") < F.col("_old") - 2), "declining").otherwise("stable")
    prior = F.greatest(F.lit(-0.005), F.least(F.lit(0.005), (F.round("beat_rate", 3) - 0.5) * 0.01))
    return g.withColumns({"trend": trend, "alpha_prior": prior}).drop("_new", "_old")


def signals(companies: DataFrame, earnings: DataFrame, sectors: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """Quality, recommendation, earnings prior and sector of each company.

    ``sectors``: symbol, sector. ``calendar``: symbol, earnings_date; the next date counts.
    """
    day = F.lit(as_of).cast("date")
    nxt = calendar.where(F.col("earnings_date") >= day).groupBy("symbol").agg(
        F.datediff(F.min("earnings_date"), day).alias("days_to_earnings"))
    d = companies.join(nxt, "symbol", "left").withColumn("days_to_earnings", F.coalesce("days_to_earnings", F.lit(999)))
    d = recommendation(quality_score(d)).join(sectors, "symbol", "left")
    e = earnings_surprise(earnings).select("symbol", "beat_rate", "avg_surprise_pct", "trend", "alpha_prior")
    d = d.join(e, "symbol", "left")
    return d.withColumns({
        "alpha_prior": F.coalesce("alpha_prior", F.lit(0.0)), "trend": F.coalesce("trend", F.lit("stable")),
        "beat_rate": F.coalesce("beat_rate", F.lit(0.5))})


def quality_against_results(quality: DataFrame, results: DataFrame) -> DataFrame:
    """Correlation of quality with out-of-sample Sharpe, result and profitability."""
    d = quality.select("symbol", "quality").join(results, "symbol").withColumn("_p", (F.col("test_pnl") > 0).cast("double"))
    return d.agg(
        F.count(F.lit(1)).alias("n"), pearson("quality", "test_sharpe").alias("corr_sharpe"),
        pearson("quality", "test_pnl").alias("corr_pnl"), pearson("quality", "_p").alias("corr_profitable"))
