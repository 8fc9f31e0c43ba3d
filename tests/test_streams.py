import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.streaming import jobs as sj
from tickloom.streaming import state as ss

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
BAR = "symbol string, ts_sec long, date date, close double, imbalance_last double, spread_mean double, tick_count long"


@pytest.fixture
def plain(spark):
    """A session without the library's settings."""
    s = spark.newSession()
    s.conf.set(PROVIDER, HDFS)
    return s


def bar(sec, day=1, symbol="A"):
    return (symbol, day * 86400 + sec, dt.date(2026, 1, day), 100.0 + (sec * 7) % 11, (sec % 5) / 5, 0.1 + (sec % 3) / 10, sec % 4 + 1)


def feed(spark, path, rows, name):
    spark.createDataFrame(rows, BAR).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, path, tmp_path, per_batch=1):
    d = spark.readStream.schema(BAR).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(path)
    out = str(tmp_path / "out")
    sj.drain(sj.store(ss.rolling_features(d), out, str(tmp_path / "checkpoint")))
    return {(r.symbol, r.ts_sec): r for r in spark.read.parquet(out).collect()}


def test_keyed_state_on_a_plain_session_in_two_batches(plain, tmp_path):
    src = str(tmp_path / "in")
    rows = [bar(i) for i in range(70)] + [bar(i, 2) for i in range(5)]
    feed(plain, src, rows[:40], "a")
    first = run(plain, src, tmp_path)
    feed(plain, src, [bar(20), bar(39), *rows[40:]], "b")  # two late bars, one of them known
    both = run(plain, src, tmp_path)
    assert len(first) == 40 and len(both) == len(rows)
    assert plain.conf.get(PROVIDER) == HDFS
    once = tmp_path / "once"
    feed(plain, str(once / "in"), rows, "a")
    whole = run(plain, str(once / "in"), once)
    assert {k: tuple(r) for k, r in both.items()} == {k: tuple(r) for k, r in whole.items()}
    close = [r[3] for r in rows[:70]]
    r = whole["A", 86400 + 69]
    assert r.price_mom_10s == pytest.approx((close[69] - close[59]) / close[59])
    mean = sum(close[60:70]) / 10
    assert r.realized_vol_10s == pytest.approx((sum((c - mean) ** 2 for c in close[60:70]) / 9) ** 0.5)
    assert whole["A", 2 * 86400].price_mom_10s is None and whole["A", 2 * 86400].realized_vol_10s is None


def test_every_signal_of_a_batch_is_seen(plain, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("A", at(0), at(15), "WIDEN", 2.0), ("A", at(5), at(20), "PAUSE", 3.0), ("A", at(60), at(75), "WIDEN", 1.5), ("B", at(200), at(215), "WIDEN", 1.0)]
    src = str(tmp_path / "in")
    schema = "symbol string, generated_at timestamp, expires_at timestamp, mm_action string, widen_factor double"
    plain.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    sj.drain(sj.store(ss.living_signals(plain.readStream.schema(schema).parquet(src)), out, str(tmp_path / "checkpoint")))
    got = [(r.generated_at, r.mm_action) for r in plain.read.parquet(out).where("symbol = 'A'").orderBy("generated_at").collect()]
    assert got == [(at(0), "WIDEN"), (at(5), "PAUSE"), (at(20), "NORMAL"), (at(60), "WIDEN"), (at(75), "NORMAL")]


def test_drain_has_no_limit_of_its_own(plain, tmp_path):
    class Slow:
        def awaitTermination(self, *seconds):
            assert not seconds
            return None

    assert isinstance(sj.drain(Slow()), Slow)




def test_closing_bars_do_not_make_up_for_lost_ones(spark):
    """What the stream emitted is all bars below its last watermark; closing adds the rest and nothing else."""
    from tests.conftest import SMALL
    from tickloom.catalog import streams
    from tickloom.catalog.standin import table, ticks_of
    from tickloom.operators.bars import build_bars

    ticks = ticks_of(table(spark, SMALL, "events"))
    last = ticks.agg(F.max("ts_local_ns")).first()[0] // 1_000_000 - 5000
    every = {(r.symbol, r.ts_sec) for r in build_bars(ticks, 1800).select("symbol", "ts_sec").collect()}
    open_ = {(s, t) for s, t in every if (t + 1800) * 1000 > last}
    emitted = streams._bars(spark, SMALL)
    key = lambda df: sorted((r.symbol, r.ts_sec) for r in df.select("symbol", "ts_sec").collect())
    assert key(emitted) == sorted(every - open_) and open_
    assert key(sj.closing_bars(ticks, emitted, 1800)) == sorted(open_)
    assert key(sj.closing_bars(ticks, emitted.limit(0), 1800)) == sorted(open_)


def test_late_ticks_correct_bars_and_what_follows(spark, tmp_path):
    """A feed in order, then a tick of an early second: its bar and the rows within reach get a second version."""
    from tests.conftest import SMALL, near
    from tickloom.catalog.standin import table, ticks_of
    from tickloom.operators.bars import build_bars
    from tickloom.operators.features import bar_features
    from tickloom.streaming import corrections as sc

    e = table(spark, SMALL, "events").where("event_type = 'view'").orderBy("ts")
    rows = e.collect()
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    late = rows[5]

    def feed(some):
        spark.createDataFrame(some, e.schema).coalesce(1).write.mode("append").parquet(src)
        sj.drain(sc.corrected_stream(ticks_of(sj.file_stream(spark, src, e.schema, files_per_batch=1)), out, mark, 1800))

    def now(name, columns):
        return {(r.symbol, r.ts_sec): r for r in sc.latest(spark, out, name).select("symbol", "ts_sec", "version", "n_versions", *columns).collect()}

    feed(rows[:5] + rows[6:])
    before = now("bars", ["tick_count"])
    feed([late])
    columns = ["open", "close", "tick_count", "imbalance_std", "spread_mean", "volume_delta"]
    bars = now("bars", columns)
    want = build_bars(ticks_of(e), 1800)
    second = [k for k, r in bars.items() if r.n_versions == 2 or (r.version == 1 and k not in before)]
    assert len(second) == 1 and len(bars) == want.count() and {r.version for r in before.values()} == {0}
    for r in want.collect():
        assert all(near(bars[r.symbol, r.ts_sec][c], r[c]) for c in columns)
    names = ["realized_vol_10s", "imbalance_ma_60s", "spread_zscore", "volume_ratio", "price_mom_10s"]
    feats = now("features", names)
    for r in bar_features(want).collect():
        assert all(near(feats[r.symbol, r.ts_sec][c], r[c], 1e-6) for c in names)
    day = {(r.symbol, r.ts_sec): str(r.date) for r in want.collect()}
    key = second[0]
    assert {k for k, r in feats.items() if r.version == 1} == {k for k in feats if day[k] == day[key] and k[1] >= key[1]}


def test_a_change_reaches_310_rows(spark):
    from tickloom.streaming import corrections as sc

    d = spark.range(2000).selectExpr("'A' AS symbol", "id AS ts_sec", "date'2026-01-01' AS date", "id IN (700, 1500) AS _new")
    got = [(r.ts_sec, r._out) for r in sc.reached(d).orderBy("ts_sec").collect()]
    assert [t for t, _ in got] == [*range(390, 1011), *range(1190, 1811)]
    assert [t for t, o in got if o] == [*range(700, 1011), *range(1500, 1811)]


def test_living_signals_call_the_state_once_a_bucket():
    """A bucket of 300 symbols costs a few calls, and each of them gets its default when its time has come."""
    import pandas as pd

    calls, stored = [], []

    class Handle:
        def getListState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *x: calls.append((name, *x))

        def get(self):
            calls.append(("get",))
            return iter(stored)

        def put(self, rows):
            calls.append(("put",))
            stored[:] = rows

        def clear(self):
            stored.clear()

    start = pd.Timestamp(2026, 1, 1)
    born = [start + pd.Timedelta(minutes=i) for i in range(300)]
    rows = pd.DataFrame({"symbol": [f"S{i}" for i in range(300)], "generated_at": born, "mm_action": "WIDEN", "widen_factor": 2.0,
                         "expires_at": [t + pd.Timedelta(minutes=15) for t in born]})
    p = ss.LivingSignal()
    p.init(Handle())
    assert sum(map(len, p.handleInputRows((0,), iter([rows]), None))) == 300
    first = int((start + pd.Timedelta(minutes=15)).value // 1_000_000)
    assert calls == [("get",), ("put",), ("registerTimer", first)]
    at = type("At", (), {"getExpiryTimeInMs": lambda self: first, "getCurrentWatermarkInMs": lambda self: first + 60_000 * 100})()
    gone = pd.concat(p.handleExpiredTimer((0,), at, at))
    assert len(gone) == 100 and gone.is_default.all() and len(stored) == 200
    assert calls[-1] == ("registerTimer", first + 60_000 * 100)
