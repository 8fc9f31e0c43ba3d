"""Hand-made cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, near, rows
from tickloom.functions import pricing, text
from tickloom.functions import symbols as sy
from tickloom.operators import bars as ob
from tickloom.operators import ledger, model, pairs, params, profile, quality, signals
from tickloom.plans import nightly
from tickloom.session import scratch_path
from tickloom.sources import storage


def tick(i, ns, price, volume, imb=0.5):
    lad = [x for k in range(5) for x in (price - 0.05 * (k + 1), 10)] + [x for k in range(5) for x in (price + 0.05 * (k + 1), 20)]
    return (i, ns, "A26MAYFUT", price, volume, price, 7, 0.1, price, imb, 100, 50, *lad)


TICK = ("tick_id long, ts_local_ns long, symbol string, last_price double, volume long, avg_price double, oi long, spread double, mid_price double, "
        "book_imbalance double, total_bid_qty long, total_ask_qty long, "
        + ", ".join(f"{s}_p{i} double, {s}_q{i} long" for s in ("bid", "ask") for i in range(1, 6)))


def test_first_and_last_follow_time_then_tiebreak(spark):
    ns = 1778670000_000000000
    t = [tick(3, ns + 5, 102.0, 30), tick(1, ns + 1, 100.0, 10), tick(2, ns + 5, 101.0, 20), tick(4, ns + 9, 0.0, 99)]
    for n in (1, 8):
        b = ob.build_bars(spark.createDataFrame(t, TICK).repartition(n)).first()
        assert (b.open, b.high, b.low, b.close, b.volume_delta, b.tick_count) == (100.0, 102.0, 100.0, 102.0, 20, 3)


def test_runs_leave_out_the_open_one(spark):
    counts = [1, 9, 9, 1, 5, 9, 5, 5, 1, 9]
    d = spark.createDataFrame([("a", 1778670000 + i, c) for i, c in enumerate(counts)], "symbol string, ts_sec long, tick_count long")
    r = profile.run_lengths(d.withColumn("date", F.lit("2026-05-13").cast("date"))).first()
    assert (r.p25, r.p75) == (2.0, 9.0)
    assert r.median_quiet == 1.0 and r.median_burst is None


def test_minute_coverage(spark):
    open_sec = 1778643900  # 09:15 IST
    d = spark.createDataFrame([("A", open_sec + 60 * m) for m in (0, 1, 5, 6)], "symbol string, ts_sec long")
    d = d.withColumn("date", F.lit("2026-05-13").cast("date"))
    c = quality.minute_coverage(d).first()
    assert (c["rows"], c.expected_minutes, c.n_missing, c.max_gap) == (4, 375, 371, 368)
    full = spark.createDataFrame([("A", open_sec + 60 * m) for m in range(375) if m not in (2, 3, 4)], "symbol string, ts_sec long")
    c = quality.minute_coverage(full.withColumn("date", F.lit("2026-05-13").cast("date"))).first()
    assert (c.missing, c.max_gap, c.status) == ([557, 558, 559], 3, "MINOR_GAPS")


def fills(spark, legs, lot=75):
    return spark.createDataFrame(
        [("A", i, s, float(p), q, lot, "equity_futures") for i, (s, p, q) in enumerate(legs)],
        "symbol string, i int, side string, price double, quantity int, lot_size int, instrument_type string",
    ).withColumn("date", F.lit("2026-05-13").cast("date"))


def test_round_trip_profit(spark):
    d = ledger.position_ledger(fills(spark, [("BUY", 23880, 1), ("SELL", 23885, 1)]), ["i"])
    assert d.agg(F.sum("pnl")).first()[0] == 375.0


def test_long_only_and_flipping_ledgers(spark):
    legs = [("BUY", 100, 2), ("BUY", 110, 2), ("SELL", 120, 3), ("SELL", 90, 2), ("SELL", 80, 1), ("BUY", 85, 4)]
    f = fills(spark, legs, 1)
    m = ledger.session_metrics(f, ["i"]).first()
    # average 105: three at 120, then two at 90 although one is left; the next sale finds no inventory
    assert near(m.gross_pnl, 15 * 3 - 15 * 2) and m.max_inventory == 4 and m.final_inventory == 2
    p = rows(ledger.position_ledger(f, ["i"]).select("i", "lots", "avg_price", "pnl"), "i")
    assert [r[1] for r in p] == [2, 4, 1, -1, -2, 2]
    assert near(p[2][3], 45.0) and near(p[3][3], -15.0) and near(p[4][2], 85.0) and near(p[5][3], 0.0) and near(p[5][2], 85.0)


def test_position_ledger_does_not_depend_on_blocks(spark):
    rnd = random.Random(1)
    legs = [(rnd.choice(["BUY", "SELL"]), 100 + rnd.random(), rnd.randint(1, 5)) for _ in range(200)]
    f = fills(spark, legs)
    a, b = (rows(ledger.position_ledger(f, ["i"], block_rows=n).select("i", "lots", "avg_price", "pnl", "realized_pnl"), "i") for n in (7, 10_000))
    assert all(near(x, y, 1e-9) for r, s in zip(a, b) for x, y in zip(r, s))


def slow_session(legs, lot):
    """The rule, fill by fill: sales count while inventory is positive."""
    inv, basis, path, sales, peak = 0, 0.0, 0, [], 0
    for side, price, qty in legs:
        path += qty if side == "BUY" else -qty
        peak = max(peak, abs(path))
        if side == "BUY":
            basis, inv = basis + price * qty, inv + qty
        elif inv > 0:
            sales.append((price - basis / inv) * qty * lot)
            basis, inv = basis - basis / inv * qty, inv - qty
    run = np.cumsum(sales) if sales else np.zeros(1)
    rest = np.array(sales[1:])
    sharpe = rest.mean() / rest.std() * math.sqrt(252) if len(rest) and rest.std() > 0 else 0.0
    return (len(legs), sum(x[0] == "BUY" for x in legs), sum(sales), sharpe, (run - np.maximum.accumulate(run)).min(),
            (rest > 0).mean() if len(rest) else 0.0, peak, path)


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_drawdown_does_not_depend_on_blocks(spark, block_rows):
    """Several symbols, one of them in many blocks; sorted fills are not shuffled again."""
    rnd = random.Random(4)
    own = [(s, i, rnd.choice(["BUY", "SELL"]), rnd.randint(90, 110), rnd.randint(1, 9)) for s, n in (("A", 200), ("B", 2), ("C", 1)) for i in range(n)]
    f = spark.createDataFrame(own, "symbol string, i int, side string, price int, quantity int").withColumn("lot_size", F.lit(5))
    led = ledger.position_ledger(f, ["i"], block_rows=block_rows)
    plan = led._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    got = rows(ledger.drawdown(led).select("symbol", "i", "realized_pnl", "peak", "drawdown"), "symbol", "i")
    want = []
    for s in "ABC":
        lots = avg = real = 0.0
        peak = -math.inf
        for _, i, side, p, q in [r for r in own if r[0] == s]:
            q = q if side == "BUY" else -q
            if lots * q < 0:
                real += (p - avg) * min(abs(q), abs(lots)) * 5 * (1 if lots > 0 else -1)
                avg = p if abs(q) > abs(lots) else avg
            else:
                avg = (avg * abs(lots) + p * abs(q)) / abs(lots + q)
            lots, peak = lots + q, max(peak, real)
            want.append((s, i, real, peak, real - peak))
    assert len(got) == len(want) and all(near(x, y, 1e-7) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("share,seed", [(0.5, 1), (0.35, 2), (0.65, 3), (0.5, 4)])
def test_session_metrics_do_not_depend_on_blocks(spark, share, seed):
    rnd = random.Random(seed)
    made = {s: [(rnd.choices(["BUY", "SELL"], [share, 1 - share])[0], 100 + rnd.random(), rnd.randint(1, 9)) for _ in range(n)]
            for s, n in (("A", 900), ("B", 40), ("C", 1), ("D", 7))}
    made["E"] = [("SELL", 100.0, 3)] * 20
    made["F"] = [("BUY", 100.0, 60)] * 12 + [("SELL", 101.0, 7)] * 300
    f = spark.createDataFrame(
        [(s, i, *leg, 5, "equity_futures") for s, legs in made.items() for i, leg in enumerate(legs)],
        "symbol string, i int, side string, price double, quantity int, lot_size int, instrument_type string",
    ).withColumn("date", F.lit("2026-05-13").cast("date")).repartition(4)
    for n in (7, 50_000):
        found = {r.symbol: r for r in ledger.session_metrics(f, ["i"], block_rows=n).collect()}
        assert set(found) == set(made)
        for s, legs in made.items():
            r, want = found[s], slow_session(legs, 5)
            got = (r.total_fills, r.buy_fills, r.gross_pnl, r.sharpe, r.max_drawdown, r.win_rate, r.max_inventory, r.final_inventory)
            assert all(near(a, b, 1e-7) for a, b in zip(got, want)), (s, n, got, want)
    assert ledger.session_metrics(f.limit(0), ["i"]).count() == 0


def test_inventory_maps():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        n = int(rnd.integers(1, 200))
        buy, qty = rnd.random(n) < rnd.random(), rnd.integers(1, 12, n)
        out = ledger.inventory_after(buy, qty, -15, 90, every=16)
        for x in range(-15, 91):
            inv = x
            for b, q in zip(buy.tolist(), qty.tolist()):
                inv = inv + q if b else inv - q if inv > 0 else inv
            assert out[x + 15] == inv


def test_normal_distribution():
    x = np.linspace(-9, 9, 2001)
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(pricing.norm_cdf(x) - want).max() < 1e-14


def test_price_to_volatility_and_back():
    n = 500
    rng = np.random.default_rng(2)
    s, k, t, v = rng.uniform(90, 110, n), rng.uniform(85, 115, n), rng.uniform(0.02, 1, n), rng.uniform(0.1, 1.5, n)
    call = rng.random(n) < 0.5
    p = pricing.bs_price(s, k, t, 0.07, v, call)
    got = pricing.solve_vol(p, s, k, t, 0.07, call)
    keep = p - np.maximum(0, np.where(call, s - k * np.exp(-0.07 * t), k * np.exp(-0.07 * t) - s)) > 1e-3
    keep &= p >= np.where(call, s - k, k - s)  # below that a price counts as wrong
    assert keep.sum() > 400
    assert np.abs(got - v)[keep].max() < 1e-6
    one, two = pricing.bs_price(s, k, t, 0.07, v, True), pricing.bs_price(s, k, t, 0.07, v, False)
    assert np.abs(one - two - (s - k * np.exp(-0.07 * t))).max() < 1e-10
    g = pricing.greeks(s, k, t, 0.07, v, call)
    bump = (pricing.bs_price(s + 1e-4, k, t, 0.07, v, call) - pricing.bs_price(s - 1e-4, k, t, 0.07, v, call)) / 2e-4
    assert np.abs(g["delta"] - bump).max() < 1e-6


def slow_episodes(z, entry, leave, stop, hold):
    out, side, a = [], 0, 0
    for i in range(1, len(z)):
        if not side:
            side = -1 if z[i] > entry else 1 if z[i] < -entry else 0
            a = i
            continue
        done = z[i] < leave if side == -1 else z[i] > -leave
        stopped = z[i] > stop if side == -1 else z[i] < -stop
        late = i - a >= hold
        if done or stopped or late:
            out.append((a, i, side, stopped, late))
            side = 0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_episodes_match_a_plain_loop(seed):
    z = np.cumsum(np.random.default_rng(seed).normal(size=800)) * 0.4
    z -= z.mean()
    for e, l, s, h in ((1.5, 0.0, 3.5, 40), (2.0, 0.5, 4.0, 5), (1.0, 0.75, 1.2, 300)):
        assert pairs._episodes(z, e, l, s, h) == slow_episodes(z, e, l, s, h)


def test_cointegration_statistics(spark):
    rng = np.random.default_rng(4)
    x = 100 + np.cumsum(rng.normal(size=600) * 0.1)
    e = np.zeros(600)
    for i in range(1, 600):
        e[i] = 0.8 * e[i - 1] + rng.normal() * 0.2
    y = 1.3 * x + 5 + e
    d = spark.createDataFrame([("a|b", "s", "a", "b", i, float(u), float(v)) for i, (u, v) in enumerate(zip(y, x))],
                              "symbol string, sector string, sym1 string, sym2 string, ts_sec long, y double, x double")
    r = pairs.screen(d.withColumn("date", F.lit("2026-05-13").cast("date"))).first()
    b = np.polyfit(x, y, 1)[0]
    s = y - b * x
    w, u, v = np.diff(s)[1:], s[1:-1], np.diff(s)[:-1]
    m = np.column_stack([np.ones(len(u)), u, v])
    beta, res, *_ = np.linalg.lstsq(m, w, rcond=None)
    se = math.sqrt(res[0] / (len(w) - 3) * np.linalg.inv(m.T @ m)[1, 1])
    assert near(r.hedge_ratio, b, 1e-8) and near(r.adf_stat, beta[1] / se, 1e-6) and r.pvalue < 1e-6


def test_unit_root_pvalues(spark):
    # published critical values of the statistic: -3.43, -2.86, -2.57 at 1, 5 and 10 %
    got = spark.createDataFrame([(t,) for t in (-3.43, -2.86, -2.57)], "t double").select(pairs.unit_root_pvalue(F.col("t"))).collect()
    for (p,), want in zip(got, (0.01, 0.05, 0.10)):
        assert abs(p - want) < 0.002


def test_contract_symbols(spark):
    syms = ["CHOLAFIN26JANFUT", "NIFTY26MAY24000CE", "NIFTY2650524000CE", "RELIANCE", "USDINR26529FUT", "BAJAJ-AUTO26MAYFUT"]
    d = spark.createDataFrame([(s,) for s in syms], "symbol string")
    assert [r[0] for r in d.select(sy.previous_contract("symbol")).collect()][:1] == ["CHOLAFIN25DECFUT"]
    o = {r.symbol: r for r in sy.parse_options(d).collect()}
    assert (o["NIFTY26MAY24000CE"].strike, str(o["NIFTY26MAY24000CE"].expiry)) == (24000.0, "2026-05-28")
    assert (o["NIFTY2650524000CE"].strike, str(o["NIFTY2650524000CE"].expiry)) == (24000.0, "2026-05-05")
    assert [r[0] for r in d.select(sy.instrument_class("symbol")).collect()] == ["FUT", "CE", "CE", "EQUITY", "CURRENCY", "FUT"]
    assert [r[0] for r in d.select(sy.strip_contract("symbol")).collect()][5] == "BAJAJ-AUTO"
    e = spark.sql("SELECT date'2026-05-01' m UNION ALL SELECT date'2027-05-01'").select(sy.contract_expiry(F.col("m"))).collect()
    assert sorted(str(x[0]) for x in e) == ["2026-05-26", "2027-05-27"]


def test_symbols_inside_text(spark):
    items = spark.createDataFrame([("1", "abc Reliance and tcs, NSE: INFY"), ("2", "nothing"), ("3", "RELIANCETCS"), ("3", "tcs tcs"), ("4", None), ("5", "")],
                                  "id string, headline string")
    u = spark.createDataFrame([("RELIANCE",), ("TCS",), ("ABCD",), ("C",), ("",)], "symbol string")
    found = rows(signals.extract_symbols(items, u), "id", "symbol")
    assert found == [("1", "C"), ("1", "INFY"), ("1", "RELIANCE"), ("1", "TCS"), ("3", "C"), ("3", "RELIANCE"), ("3", "TCS")]
    assert signals.contained_symbols(items, u.limit(0), "id", "headline").count() == 0


def test_symbols_in_texts_with_a_sharp_s(spark):
    """Upper case is that of the reference's language: one letter may become two."""
    text = "Theßtea, NSE: Straße"
    items = spark.createDataFrame([("1", text)], "id string, headline string")
    u = spark.createDataFrame([("THESSTEA",), ("THE",)], "symbol string")
    assert "THESSTEA" in text.upper()
    assert rows(signals.extract_symbols(items, u), "symbol") == [("1", "STRASSE"), ("1", "THE"), ("1", "THESSTEA")]


def test_symbols_anywhere_in_long_texts(spark):
    """Symbols of many lengths, at the blocks' edges, one inside another, beyond ASCII; more of them than bits."""
    rnd = random.Random(5)
    letters = "ABCDEFGHÄ"
    names = {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 90))) for _ in range(400)} | {"Q" * 150, "ÄB"}
    items = []
    for i in range(30):
        t = "".join(rnd.choice(letters.lower() + " ") for _ in range(rnd.randint(0, 700)))
        for _ in range(4):
            at = rnd.randint(0, len(t))
            t = t[:at] + rnd.choice(sorted(names)) + t[at:]
        items.append((i, t + "\nline\r\n" + "q" * rnd.randint(0, 200)))
    d = spark.createDataFrame(items, "id long, headline string")
    u = spark.createDataFrame([(x,) for x in names], "symbol string")
    want = {(i, x) for i, t in items for x in names if x in t.upper()}
    assert {tuple(r) for r in signals.contained_symbols(d, u, "id", "headline").collect()} == want
    most = signals.MOST_BITS
    try:
        signals.MOST_BITS = 64
        assert {tuple(r) for r in signals.contained_symbols(d, u, "id", "headline").collect()} == want
    finally:
        signals.MOST_BITS = most


def test_texts_are_searched_once_and_stay_where_they_are(spark):
    """Each text is searched once, few places are tested for every length, and texts do not move to the tags."""
    items = spark.createDataFrame([(f"i{i}", "some text of Tata Steel and xyz " * 3) for i in range(9)], "id string, headline string")
    u = spark.createDataFrame([("STEEL",), ("NOTHING",), ("TATA",)], "symbol string")
    items = signals.stage(items, "items")
    plan = signals.contained_symbols(items, u, "id", "headline")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython|MapInArrow", plan)) == 1
    tagged = signals.tag_symbols(items, u)
    assert {tuple(r.symbols) for r in tagged.collect()} == {("STEEL", "TATA")}
    assert "headline" not in tagged.select("id", "symbols")._jdf.queryExecution().executedPlan().toString()
    kept = signals.relevant(tagged, u).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count("upper(") == 1
    f = signals.Filter(1 << 12, [4, 5, 6, 7])
    tested, slots = [], f.slots
    f.slots = lambda h, k: tested.append(len(h)) or slots(h, k)
    list(f.pieces("x" * 10_000))
    assert sum(tested) < 20_000


def test_trading_dates_reach_as_far_as_needed(spark):
    closed = spark.range(30).selectExpr("date_sub(date'2026-05-13', cast(id as int) + 1) day")
    d = spark.sql("SELECT date'2026-05-13' date")
    got = sy.recent_trading_dates(d, closed, 100).orderBy("nth").collect()
    assert len(got) == 100 and str(got[0].day) == "2026-04-10"


def test_most_cautious_signal_wins(spark):
    ev = spark.createDataFrame([("A", "EARNINGS", 0, "PAUSE", 3.0, 120, True)],
                               "contract string, event_type string, days_until int, action string, factor double, pause_minutes int, has_event boolean")
    nw = spark.createDataFrame([("A", 0.9, "WIDEN", 2.0, 0, 0.1, "LOW", "macro"), ("B", 0.2, "WIDEN", 2.0, 0, 0.1, "LOW", "macro")],
                               "contract string, uncertainty double, mm_action string, widen_factor double, pause_minutes int, sentiment double, "
                               "informed_flow_risk string, event_type string")
    syms = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    g = {r.symbol: r for r in signals.aggregate_signals(signals.components(ev, nw, "2026-05-13 04:00:00"), syms, "2026-05-13 04:00:00").collect()}
    assert (g["A"].mm_action, g["A"].widen_factor, g["A"].asymmetry_risk, g["A"].source) == ("PAUSE", 4.0, "HIGH", "NEWS")
    assert (g["B"].mm_action, g["B"].widen_factor) == ("NORMAL", 1.0) and g["C"].reason == "All clear"


def test_dates_of_every_form(spark):
    d = spark.createDataFrame([("05-Jan-2024",), ("2024-01-05",), ("Fri, 05 Jan 2024 10:00:00 +0530",), ("soon",)], "t string")
    got = [r[0] and str(r[0]) for r in d.select(text.parse_date(F.col("t"))).collect()]
    assert got == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 04:30:00", None]


def test_transfer_keeps_bounds_and_falls_back(spark):
    p = spark.createDataFrame([("A26MAYFUT", k, v) for k, v in (("gamma", 0.01), ("kappa", 1.5), ("min_spread", 0.1), ("open_mult", 1.2))]
                              + [("B26MAYFUT", "gamma", 0.01)], "symbol string, key string, value double")
    r = spark.createDataFrame([("A26MAYFUT", "A26JUNFUT", 2.0), ("B26MAYFUT", "B26JUNFUT", 2.0)], "old_symbol string, new_symbol string, vol_ratio double")
    t = {(x.symbol[0], x.key): x for x in params.transfer(p, r).collect()}
    assert near(t["A", "gamma"].value, 0.02) and near(t["A", "kappa"].value, 1.5 * math.sqrt(2)) and near(t["A", "open_mult"].value, 1.2 * 1.3)
    assert not t["B", "gamma"].is_valid and t["B", "gamma"].value == 0.01


def test_model_evaluation(spark):
    d = spark.createDataFrame([("A", 1, 0.7, 0.2), ("A", -1, 0.7, 0.66), ("A", 0, 0.9, 0.1), ("A", 1, 0.3, 0.8), ("A", -1, 0.5, 0.5)],
                              "symbol string, label int, p_up double, p_down double")
    e = {r.threshold: r for r in model.evaluate(d).collect()}
    assert near(e[0.55].accuracy, 2 / 3) and e[0.55].n_signals == 3 and near(e[0.55].signal_rate, 0.8)
    assert model.verdicts(model.evaluate(d)).first().best_threshold == 0.55


def test_nightly_batch_and_its_backlog(spark):
    ns = 1778670000_000000000
    t = spark.createDataFrame([tick(i, ns + i * 400_000_000 + (i // 50) * 86400_000000000, 100.0 + i % 3, i) for i in range(100)], TICK)
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    storage.write_ticks(t, raw)
    schema = t.withColumn("date", F.lit(None).cast("date")).schema
    nightly.run(spark, raw, out, schema, first=True)
    first = spark.read.parquet(out)
    assert first.agg(F.sum("tick_count")).first()[0] == 100 and first.select("date").distinct().count() == 2
    ticks, done = storage.scan(spark, raw, schema), storage.scan(spark, out, nightly.STORED, key="base")
    assert nightly.backlog(ticks, done, 1).count() == 0 and nightly.backlog(ticks, done, 10_000).count() == 2
    nightly.run(spark, raw, out, schema, min_rows=10_000)
    assert spark.read.parquet(out).agg(F.sum("tick_count")).first()[0] == 100


def test_days_with_different_columns(spark):
    """An older day lacks a column, a newer one has it: both read by the declared schema, with a default if one is given."""
    path = scratch_path(spark, "days")
    old = spark.sql("SELECT 'A' symbol, 'A' base, 10 ts_sec, 40000 ist_tod, 1.5D close, date'2026-01-05' date")
    new = spark.sql("SELECT 'A' symbol, 'A' base, 20 ts_sec, 40000 ist_tod, 2.5D close, 7L oi, date'2026-01-06' date")
    for d in (old, new):
        d.write.mode("append").partitionBy("date", "base").parquet(path)
    day = lambda date, **more: storage.load_day(spark, path, new.schema, "A", date, **more).first()
    assert (day("2026-01-05").close, day("2026-01-05").oi, day("2026-01-06").oi) == (1.5, None, 7)
    assert day("2026-01-05", defaults={"oi": 0, "vega": 0.5}).asDict()["oi"] == 0 and day("2026-01-06", defaults={"vega": 0.5}).vega == 0.5


def test_scans_are_pruned(spark):
    from tickloom.catalog.standin import ticks

    path = scratch_path(spark, "ticks")
    storage.write_ticks(ticks(spark, SMALL), path)
    schema = ticks(spark, SMALL).withColumn("date", F.lit(None).cast("date")).schema
    d = storage.scan(spark, path, schema, start="2024-01-05", end="2024-01-06", symbols=["click"]).select("last_price")
    plan = d._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan and "ReadSchema: struct<last_price:double>" in plan


def plain_exponential(x, y, a, k):
    """The damped loop with arrays."""
    mu, sse = 1e-3, ((y - a * np.exp(-k * x)) ** 2).sum()
    for _ in range(200):
        e = np.exp(-k * x)
        j = np.stack([e, -a * x * e], axis=1)
        h = j.T @ j
        try:
            d = np.linalg.solve(h + mu * np.diag(np.diag(h)), j.T @ (y - a * e))
        except np.linalg.LinAlgError:
            return None
        small = abs(d[0]) <= 1e-10 * (abs(a) + 1e-10) and abs(d[1]) <= 1e-10 * (abs(k) + 1e-10)
        trial = ((y - (a + d[0]) * np.exp(-(k + d[1]) * x)) ** 2).sum()
        if trial <= sse:
            a, k, sse, mu = a + d[0], k + d[1], trial, max(mu / 10, 1e-12)
        else:
            mu *= 10
        if small:
            return a, k, sse
        if mu > 1e15:
            return None
    return None


def test_exponential_fits_equal_a_plain_loop(spark):
    from tickloom.operators import fits

    rnd = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(25):
        n = int(rnd.integers(3, 21))
        x = np.sort(rnd.uniform(0, 3, n))
        a, k = rnd.uniform(0.1, 50), rnd.uniform(-0.3, 4)
        y = a * np.exp(-k * x) + rnd.normal(size=n) * a * 0.05
        start = a * rnd.uniform(0.3, 2), k + rnd.uniform(-0.8, 0.8)
        rows += [(g, float(p), float(q), *map(float, start)) for p, q in zip(x, y)]
        want[g] = plain_exponential(x, y, *start)
    rows += [(90, 1.0, 2.0, 1.0, 1.0)] * 4 + [(91, float(i), 0.0, 1.0, 1.0) for i in range(5)] + [(92, 1.0, 1.0, None, 1.0), (92, 2.0, 1.0, None, 1.0)]
    d = spark.createDataFrame(rows, "g int, x double, y double, a0 double, k0 double")
    out = {r.g: r for r in fits.exponential_fits(d.select("g", "x", "y"), ["g"], d.select("g", "a0", "k0").distinct()).collect()}
    assert sum(w is not None for w in want.values()) > 20
    for g, w in want.items():
        r = out[g]
        assert (r.a is None) == (w is None), g
        if w is not None:
            assert near(r.a, w[0], 1e-6) and near(r.k, w[1], 1e-6) and near(r.sse, w[2], 1e-6) and r.steps < 200
    assert out[92].a is None and out[92].r2 is None and out[90].n_points == 4  # no start, and no curve through one place


def test_two_series_unit_root(spark):
    rnd = np.random.default_rng(12)
    n, lags, rows = 400, 4, []
    for name, pull in (("A|B", 0.15), ("A|C", 0.0)):
        x, e = 100 + np.cumsum(rnd.normal(size=n)), np.zeros(n)
        for t in range(2, n):
            e[t] = (1 - pull) * e[t - 1] + 0.3 * (e[t - 1] - e[t - 2]) + rnd.normal()
        y = 3 + 1.7 * x + e
        rows += [(name, "s", *name.split("|"), f"2026-01-{1 + t // 150:02d}", t, float(y[t]), float(x[t])) for t in range(n)]
    d = spark.createDataFrame(rows, "symbol string, sector string, sym1 string, sym2 string, date string, ts_sec long, y double, x double").withColumn(
        "date", F.col("date").cast("date"))
    out = {(r.symbol, r.lag): r for r in pairs.cointegration(d, lags, block_rows=64).collect()}
    for name in ("A|B", "A|C"):
        own = [r for r in rows if r[0] == name]
        y, x = np.array([r[6] for r in own]), np.array([r[7] for r in own])
        fit = np.polyfit(x, y, 1)
        e = y - np.polyval(fit, x)
        de, scores = np.diff(e), []
        for p in range(lags + 1):
            at = np.arange(lags, n - 1)  # rows with all changes before them
            z = np.stack([e[at], *[de[at - i] for i in range(1, p + 1)]], axis=1)
            beta, *_ = np.linalg.lstsq(z, de[at], rcond=None)
            sse = ((de[at] - z @ beta) ** 2).sum()
            se = math.sqrt(sse / (len(at) - p - 1) * np.linalg.inv(z.T @ z)[0, 0])
            scores.append(len(at) * math.log(sse / len(at)) + 2 * (p + 1))
            r = out[name, p]
            assert r.n == len(at) and near(r.statistic, beta[0] / se, 1e-6) and near(r.aic, scores[-1], 1e-6)
        assert [out[name, p].chosen for p in range(lags + 1)] == [p == int(np.argmin(scores)) for p in range(lags + 1)]
    best = {s: next(r for r in out.values() if r.symbol == s and r.chosen) for s in ("A|B", "A|C")}
    assert best["A|B"].pvalue < 0.01 < 0.1 < best["A|C"].pvalue


def test_published_p_values_of_two_series(spark):
    """At the published 5 % and 1 % points of two series with a constant."""
    d = spark.createDataFrame([(-3.34,), (-3.90,), (-3.04,), (5.0,), (-30.0,)], "t double")
    p = [r[0] for r in d.select(pairs.unit_root_pvalue(
        F.col("t"), pairs.P_SMALL_2, pairs.P_LARGE_2, pairs.TAU_STAR_2, pairs.TAU_MIN_2, pairs.TAU_MAX_2)).collect()]
    assert abs(p[0] - 0.05) < 0.004 and abs(p[1] - 0.01) < 0.002 and abs(p[2] - 0.10) < 0.005 and p[3:] == [1.0, 0.0]


def test_a_second_night_reads_only_itself(spark):
    from tickloom.operators.ranks import quantiles
    from tickloom.plans import rollup

    rnd = random.Random(3)
    rows = [("A" if i % 3 else "B", f"2026-05-{11 + d}", 1778470000 + d * 86400 + i * 30, rnd.gauss(5, 2), None if i % 9 == 0 else rnd.random())
            for d in range(4) for i in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, date string, ts_sec long, x double, y double").withColumn("date", F.col("date").cast("date"))
    path, src = scratch_path(spark, "state"), scratch_path(spark, "bars")
    storage.write_partitioned(bars, src, ["date"], ["symbol", "ts_sec"])
    stored = spark.read.parquet(src)
    metrics = ["x", "y"]
    assert len(rollup.update(spark, stored.where("date < '2026-05-14'"), path, metrics)) == 3
    assert [str(d) for d in rollup.update(spark, stored, path, metrics)] == ["2026-05-14"]
    assert rollup.update(spark, stored, path, metrics) == []
    files = spark.read.parquet(f"{path}/moments").select(F.col("_metadata.file_modification_time").alias("at"), "date")
    late = files.groupBy("date").agg(F.max("at").alias("at")).orderBy("at").collect()
    assert str(late[-1].date) == "2026-05-14"
    # a corrected day replaces its own state
    rollup.update(spark, stored, path, metrics, days=[late[0].date])
    for column in metrics:
        got = {r.symbol: r for r in rollup.merged_moments(rollup.state(spark, path, "moments"), ["symbol", "metric"]).where(F.col("metric") == column).collect()}
        want = bars.groupBy("symbol").agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.min(column).alias("lo"))
        for r in want.collect():
            g = got[r.symbol]
            assert (g.n, g.low) == (r.n, r.lo) and near(g.mean, r.m) and near(g.std, r.s)
        q = {r.symbol: r for r in rollup.merged_quantiles(rollup.state(spark, path, "buckets").where(F.col("metric") == column), ["symbol"], {"p25": 0.25, "p90": 0.9}).collect()}
        for r in quantiles(bars, ["symbol"], column, {"p25": 0.25, "p90": 0.9}).collect():
            assert abs(q[r.symbol].p25 - r.p25) < 0.05 * abs(r.p25) and abs(q[r.symbol].p90 - r.p90) < 0.05 * abs(r.p90)
    part = rollup.merged_moments(rollup.state(spark, path, "moments", "2026-05-12", "2026-05-13"), ["metric"]).where("metric = 'x'").first()
    assert part.n == 600
    cover = rollup.merged_coverage(rollup.state(spark, path, "coverage")).collect()
    assert {r.n_days for r in cover} == {4} and all(0 < r.coverage < 1 for r in cover)


def test_replayed_messages(spark, tmp_path):
    """Stopping between two batches loses and repeats nothing; broken messages go to the rejects."""
    import json

    from tickloom.sources import replay
    from tickloom.streaming import jobs as sj

    book = {"buy": [{"price": 9.5, "quantity": 3, "orders": 1}], "sell": [{"price": 10.5, "quantity": 1, "orders": 2}]}
    depth = lambda i: ("depth", i, json.dumps({"symbol": "A", "last_price": 10.0 + i, "volume_traded": i, "depth": book,
                                               "total_buy_quantity": 30, "total_sell_quantity": 10}))
    text = lambda i: ("text", i, json.dumps({"symbol": "B", "lp": str(i), "v": "x", "bp1": "1.5", "bq1": "4", "sp1": "2.5", "sq1": "2"}))
    bad = [("depth", 900, "{broken"), ("text", 901, json.dumps({"lp": "1"})), ("fax", 902, json.dumps({"symbol": "C"})), (None, 903, None)]
    src, out, mark = (str(tmp_path / x) for x in ("recording", "out", "checkpoint"))
    feeds = [[depth(i) for i in range(50)] + bad[:2], [text(i) for i in range(50, 80)] + bad[2:], [depth(99)]]
    for feed in feeds:
        replay.record(spark.createDataFrame(feed, "feed string, ts_local_ns long, body string").repartition(2), src)
        sj.drain(replay.ingest_recording(replay.replay(spark, src, rows_per_task=7), out, mark))
    sj.drain(replay.ingest_recording(replay.replay(spark, src), out, mark))  # nothing new
    ticks = spark.read.parquet(f"{out}/ticks")
    assert sorted(r.ts_local_ns for r in ticks.collect()) == [*range(80), 99]
    assert {r.batch for r in ticks.select("batch").collect()} == {0, 1, 2}
    a, b = ticks.where("ts_local_ns = 3").first(), ticks.where("ts_local_ns = 60").first()
    assert (a.symbol, a.last_price, a.volume, a.mid_price, a.book_imbalance, a.bid_q2) == ("A", 13.0, 3, 10.0, 0.5, 0)
    assert (b.symbol, b.last_price, b.volume, b.mid_price, b.total_bid_qty) == ("B", 60.0, 0, 2.0, 4)
    assert sorted(r.ts_local_ns for r in spark.read.parquet(f"{out}/rejects").collect()) == [900, 901, 902, 903]
    assert sorted(r.offset for r in spark.read.parquet(f"{out}/rejects").collect())[-1] < 84


@pytest.mark.parametrize("n,window,ties", [(700, 300, False), (400, 300, True), (60, 300, False), (300, 2, False), (1, 9, False)])
def test_sliding_median_slopes(n, window, ties):
    from tickloom.operators import kyle

    rnd = np.random.default_rng(n)
    y = np.round(rnd.normal(size=n).cumsum(), 1 if ties else 9)
    x = rnd.integers(1, 5, n).astype(float) if ties else rnd.uniform(0, 50, n)
    x[rnd.random(n) < 0.2] = np.nan
    got = kyle.sliding_median_slopes(y, x, window, first=min(20, n))
    for t in range(min(20, n), n, 7):
        low = max(0, t - window + 1)
        a, b = np.triu_indices(t - low + 1, 1)
        run = x[low:t + 1][b] - x[low:t + 1][a]
        with np.errstate(invalid="ignore"):
            keep = np.abs(run) > 1e-10
        slopes = ((y[low:t + 1][b] - y[low:t + 1][a]) / run)[keep]
        want = np.median(slopes) if len(slopes) else np.nan
        assert (np.isnan(want) and np.isnan(got[t - min(20, n)])) or abs(want - got[t - min(20, n)]) < 1e-12


def test_long_windows_equal_short_ones(spark, bars, monkeypatch):
    from tickloom.operators import kyle

    for window in (30, 45):
        short = rows(kyle.impact(bars, window).select("symbol", "ts_sec", "lambda_robust", "estimated"), "symbol", "ts_sec")
        monkeypatch.setattr(kyle, "SHORT", 0)
        long = rows(kyle.impact(bars, window, block_rows=16).select("symbol", "ts_sec", "lambda_robust", "estimated"), "symbol", "ts_sec")
        monkeypatch.setattr(kyle, "SHORT", 64)
        assert len(long) == len(short) and all(near(a, b, 1e-12) for r, q in zip(long, short) for a, b in zip(r, q) if not isinstance(a, str))


def test_symbol_search_takes_texts_whole():
    """All symbols in texts longer than a part, at its edges and at those of joined texts, with hardly a false hit."""
    rnd = random.Random(11)
    names = ["".join(rnd.choice("ABCDEFGH") for _ in range(n)) for n in (5, 6, 9, 31) for _ in range(20)]
    texts = ["".join(rnd.choice("ABCDEFGH") for _ in range(n)) for n in (0, 3, signals.CHARS + 7, 500, 3 * signals.CHARS)]
    for at in (signals.CHARS - 20, signals.CHARS - 1, signals.CHARS, 2 * signals.CHARS + 15):
        texts[4] = texts[4][:at] + names[-1] + texts[4][at:]
    texts[3] += names[0][:3]
    texts.append(names[0][3:])
    lengths, bits = sorted({len(x) for x in names}), 1 << 16
    words = {}
    for r in signals.Filter(bits, lengths).marks(names).itertuples():
        words[r.w] = words.get(r.w, 0) | r.b
    found = signals.Filter(bits, lengths, words).search([*texts, None])
    want = [{x for x in names if x in t} for t in texts] + [set()]
    assert all(w <= set(f) for f, w in zip(found, want))
    assert sum(len(f) for f in found) <= sum(map(len, want)) + 20


def test_constant_signal_is_judged_by_its_hit_rate(spark):
    """A constant signal has no coefficient: its flags and counts come from the hit rate and are never NULL."""
    from tickloom.operators import ic

    hits = {"flat": 100, "often": 110, "most": 160}  # of 200 returns that go up
    data = [(s, "2024-01-01", i, 1.0, 0.001 * (i + 1) if i < n else -0.001 * (i + 1)) for s, n in hits.items() for i in range(200)]
    d = spark.createDataFrame(data, ["symbol", "date", "ts_sec", "sig", "fwd_5"])
    got = rows(ic.ic_stability(d, ["sig"], 5).select("symbol", "ic", "useful", "strong"), "symbol")
    assert got == [("flat", None, False, False), ("most", None, True, True), ("often", None, True, False)]
    table = ic.ic_table(d.selectExpr("symbol", "'sig' AS signal", "5 AS horizon", "sig AS x", "fwd_5 AS y"), ["symbol", "signal", "horizon"])
    assert rows(ic.rank_signals(table).select("n_symbols", "n_useful", "n_strong"), "n_symbols") == [(3, 2, 1)]


def test_replayed_bodies_are_parsed_once(spark):
    from tickloom.sources import replay

    batch = spark.createDataFrame([(i, "depth" if i % 2 else "text", i, '{"symbol": "A"}') for i in range(6)],
                                  "offset long, feed string, ts_local_ns long, body string").union(
        spark.sql("SELECT 9L, 'depth', 9L, '[{\"symbol\": \"A\"}]' UNION ALL SELECT 10L, 'text', 10L, '{\"symbol\": \"A\"'"))
    ticks, bad = replay.split(batch.repartition(2))
    plan = ticks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
    assert ticks.count() == 6 and {r.offset for r in bad.collect()} == {9, 10}


def test_replay_tasks_share_no_row_group(tmp_path):
    """Every row is in one task and every row group is read by one, also where an offset lies within a group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tickloom.sources import replay

    table = pa.table({"feed": ["text"] * 95, "ts_local_ns": list(range(95)), "body": ["{}"] * 95})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=10)
    reader = replay.MessageReader({"path": str(tmp_path), "rowsPerTask": "25"})
    assert reader.latestOffset() == {"row": 95}
    for start in (0, 34):
        parts = reader.partitions({"row": start}, {"row": 95})
        groups = [g for p in parts for g in range(p.start // 10, (p.end + 9) // 10)]
        assert len(groups) == len(set(groups)) and len(parts) > 1
        assert [x for p in parts for b in reader.read(p) for x in b.column("offset").to_pylist()] == list(range(start, 95))


def test_partial_bars_sort_no_whole_file(spark, tmp_path):
    """One file of ticks: they are dealt to tasks by bar before they are sorted, and the parts make the bars of all ticks."""
    from tickloom.catalog.standin import table, ticks_of
    from tickloom.streaming import corrections as sc

    table(spark, SMALL, "events").coalesce(1).write.parquet(str(tmp_path / "one"))
    ticks = ticks_of(spark.read.parquet(str(tmp_path / "one")))
    parts = sc.partial_bars(ticks, 1800)
    plan = parts._jdf.queryExecution().sparkPlan().toString()
    steps = [x for x in plan.splitlines() if "Aggregate" in x or "Exchange" in x]
    assert "Exchange" in steps[-1], plan
    cols = ["symbol", "ts_sec", "open", "close", "tick_count", "spread_mean", "imbalance_std"]
    got, want = (rows(d.select(*cols), "symbol", "ts_sec") for d in (sc.merged(parts), ob.build_bars(ticks, 1800)))
    assert len(got) == len(want) > 0 and all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
