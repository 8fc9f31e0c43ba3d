"""Frames, ranks and scans do not depend on how rows are cut into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import near, rows
from tickloom.operators import features as ft
from tickloom.operators import ranks, regime, scans
from tickloom.operators.frames import span, with_position
from tickloom.operators.rolling import Frame, rolling, rolling_corr


def same(a, b, skip=()):
    cols = [c for c in a.columns if c not in skip]
    x, y = rows(a.select(*cols), "symbol", "ts_sec"), rows(b.select(*cols), "symbol", "ts_sec")
    assert len(x) == len(y)
    for r, s in zip(x, y):
        bad = [(c, u, v) for c, u, v in zip(cols, r, s) if not near(u, v, 1e-7)]
        assert not bad, bad[:3]


@pytest.mark.parametrize("cross", [False, True])
def test_features_do_not_depend_on_blocks(bars, cross):
    for job in (ft.bar_features, lambda b, **k: ft.flow_features(ft.bar_features(b), **k),
                lambda b, **k: ft.imbalance_measures(ft.bar_features(b), **k), lambda b, **k: ft.influence(ft.bar_features(b), window=12, **k)):
        same(job(bars, cross_day=cross, block_rows=17), job(bars, cross_day=cross, block_rows=5000))


def test_rolling_matches_pandas(spark, bars):
    s = span(bars, True, back=13, block_rows=29)
    d = rolling(s, s.df.withColumn("gap", F.when(F.col("tick_count") > 3, F.col("close"))), {
        "m": Frame("mean", "close", 10), "sd": Frame("std", "close", 10), "sp": Frame("stdp", "close", 7, 2), "su": Frame("sum", "gap", 5),
        "fu": Frame("mean", "gap", 4, full=True), "lo": Frame("min", "close", 11, 1), "hi": Frame("max", "close", 6)})
    got = s.close(rolling_corr(s, d, "co", "close", "imbalance_last", 9)).orderBy("symbol", "ts_sec").toPandas()
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        c, gap = g["close"], g["gap"]
        want = {
            "m": c.rolling(10, min_periods=1).mean(), "sd": c.rolling(10, min_periods=2).std(),
            "sp": c.shift(2).rolling(7, min_periods=1).std(ddof=0), "su": gap.rolling(5, min_periods=1).sum(),
            "fu": gap.rolling(4).mean(), "hi": c.rolling(6, min_periods=1).max(), "lo": c.shift(1).rolling(11, min_periods=1).min()}
        for k, w in want.items():
            np.testing.assert_allclose(g[k].to_numpy(float)[12:], w.to_numpy(float)[12:], atol=1e-9, err_msg=k)
        cor = c.rolling(9).corr(g["imbalance_last"]).replace([np.inf, -np.inf], np.nan)
        flat = c.rolling(9).std() < 1e-9
        np.testing.assert_allclose(g["co"].to_numpy(float)[12:][~flat[12:]], cor.to_numpy(float)[12:][~flat[12:]], atol=1e-6)
        assert (g["sd"][12:][c.rolling(10).max()[12:] == c.rolling(10).min()[12:]] == 0).all()


def test_position_without_global_sort(bars):
    d = with_position(bars, ["symbol"], "date", ["ts_sec"]).orderBy("symbol", "ts_sec").toPandas()
    for _, g in d.groupby("symbol"):
        assert list(g["_pos"]) == list(range(len(g)))


def test_no_frame_crosses_a_day(bars):
    d = ft.bar_features(bars)
    first = d.groupBy("symbol", "date").agg(F.min_by("realized_vol_300s", "ts_sec").alias("v"), F.min_by("price_mom_10s", "ts_sec").alias("m"))
    assert first.where("v IS NOT NULL OR m IS NOT NULL").count() == 0


def test_ranks_and_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=400), np.zeros(300), rng.normal(size=50) * 1e6, [1e-9, -1e-9]])
    k = np.where(np.arange(len(x)) % 3 == 0, "a", "b")
    d = spark.createDataFrame(pd.DataFrame({"k": k, "x": x}))
    got = ranks.quantiles(d, ["k"], "x", {"q0": 0.0, "q1": 0.13, "q5": 0.5, "q9": 0.99, "q10": 1.0}).toPandas().set_index("k")
    for g in "ab":
        np.testing.assert_allclose(got.loc[g].to_numpy(float), np.quantile(x[k == g], [0, 0.13, 0.5, 0.99, 1]), atol=1e-12)
    r = ranks.average_ranks(d, ["k"], "x", "r").toPandas()
    want = pd.DataFrame({"k": k, "x": x}).assign(r=lambda f: f.groupby("k")["x"].rank()).drop_duplicates(["k", "x"])
    m = want.merge(r, on=["k", "x"])
    assert len(m) == len(want) and (m.r_x == m.r_y).all()
    e = ranks.quantile_edges(d, ["k"], "x", 4).toPandas().set_index("k")
    np.testing.assert_allclose(e.loc["a", "edges"], np.quantile(x[k == "a"], [0, 0.25, 0.5, 0.75, 1]), atol=1e-12)


def test_running_totals(spark):
    d = spark.createDataFrame([("a", i // 4, i, float((i * 7) % 5 - 2)) for i in range(23)], "s string, c int, i int, v double")
    got = scans.running(d, ["s"], "c", ["i"], {"t": ("sum", "v"), "m": ("max", "v")}).orderBy("i").toPandas()
    assert np.allclose(got.t, got.v.cumsum()) and (got.m == got.v.cummax()).all()


def test_hurst_matches_plain_loop(spark):
    rng = np.random.default_rng(5)
    px = 100 * np.exp(np.cumsum(rng.normal(size=700) * 1e-3))
    d = spark.createDataFrame([("a", 1778670000 + 60 * i, float(p)) for i, p in enumerate(px)], "symbol string, ts_sec long, close double")
    d = d.withColumn("date", F.lit("2026-05-13").cast("date"))
    ret = px[1:] / px[:-1] - 1
    xs, ys = [], []
    for lag in range(2, 100):
        v = []
        for w in range(len(ret) // lag):
            a = ret[w * lag:(w + 1) * lag]
            c = np.cumsum(a - a.mean())
            if a.std() > 0:
                v.append((c.max() - c.min()) / a.std())
        xs.append(np.log(lag))
        ys.append(np.log(np.mean(v)))
    want = np.polyfit(xs, ys, 1)[0]
    for block in (101, 5000):
        assert abs(regime.hurst(d, block_rows=block).first()["hurst"] - want) < 1e-9


@pytest.mark.parametrize("weight", [5, 60, 1000])
def test_ewm_matches_pandas(spark, weight):
    rng = np.random.default_rng(9)
    x = rng.normal(size=5000)
    d = spark.createDataFrame([("a", 1778670000 + i, float(v)) for i, v in enumerate(x)], "symbol string, ts_sec long, x double")
    d = d.withColumn("date", F.lit("2026-05-13").cast("date"))
    got = regime.ewm_std(d, "x", "s", weight).orderBy("ts_sec").toPandas()["s"].to_numpy(float)
    np.testing.assert_allclose(got[1:], pd.Series(x).ewm(span=weight).std().to_numpy()[1:], atol=1e-9)
