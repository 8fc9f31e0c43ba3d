import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "tests")
    yield s
    s.stop()


@pytest.fixture
def bars(spark):
    """Two symbols, three days, 40 to 60 bars a day, with flat stretches and gaps."""
    import random

    rnd = random.Random(7)
    rows = []
    for sym in ("AAA26MAYFUT", "BBB26MAYFUT"):
        px, tick = 100.0, 0
        for day in range(3):
            for i in range(40 + 10 * day):
                px = px if 10 <= i < 22 else round(px + rnd.choice([-0.05, 0, 0.05, 0.1]), 2)
                tick += 1
                q = [rnd.randint(1, 60) for _ in range(10)]
                rows.append((sym, 1778670000 + day * 86400 + i * 60 + rnd.randint(0, 20), px, px + 0.01, rnd.uniform(-1, 1),
                             0.05 * rnd.randint(1, 3), rnd.randint(1, 9), rnd.randint(0, 5) * 10, 1000 + rnd.randint(0, 9),
                             rnd.random(), *q))
    cols = ["symbol", "ts_sec", "close", "weighted_mid", "imbalance_last", "spread_mean", "tick_count", "volume_delta", "oi", "price_impact"]
    cols += [f"{s}_q{i}" for s in ("bid", "ask") for i in range(1, 6)]
    from pyspark.sql import functions as F

    from tickloom.functions.columns import ist_date

    d = spark.createDataFrame(rows, cols)
    return d.withColumns({
        "date": ist_date(), "imbalance_mean": F.col("imbalance_last"), "spread_bps": F.col("spread_mean") / F.col("close") * 10000,
        "vwap": F.col("close"), "total_bid_qty": F.col("bid_q1") + F.col("bid_q2"), "total_ask_qty": F.col("ask_q1") + F.col("ask_q2"),
        "bid_p1": F.col("close") - 0.05, "ask_p1": F.col("close") + 0.05, "open": F.col("close"), "high": F.col("close"), "low": F.col("close")})


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def near(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b
