"""Keyed state: rolling features per symbol and the living signal per symbol."""

from __future__ import annotations

import math
import warnings
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP = 310
WINDOWS = (10, 30, 60, 300)
MEANS = (10, 30, 60)

_BAR = "ts_sec long, date date, close double, imbalance_last double, spread_mean double, tick_count long"
FEATURES = (
    "symbol string, ts_sec long, date date, close double, "
    + ", ".join(f"realized_vol_{n}s double" for n in WINDOWS) + ", "
    + ", ".join(f"imbalance_ma_{n}s double" for n in MEANS) + ", "
    + ", ".join(f"price_mom_{n}s double" for n in MEANS) + ", spread_zscore double, volume_ratio double, sigma double")


SPAN = 4096


def _spans(x: np.ndarray, n: int, first: int):
    """The last ``n`` values up to each row from ``first`` on, NaN where there are fewer; some thousand rows at a time."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])
    view = np.lib.stride_tricks.sliding_window_view(padded, n)[first:]
    for start in range(0, len(view), SPAN):
        yield view[start:start + SPAN]


def _rolled(x: np.ndarray, n: int, first: int, apply) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # spans of one value have no deviation
        return np.concatenate([apply(v) for v in _spans(x, n, first)])


def _deviations(v: np.ndarray) -> np.ndarray:
    return np.nanstd(v, axis=1, ddof=1)


def _means(v: np.ndarray) -> np.ndarray:
    return np.nanmean(v, axis=1)


def _features(day: pd.DataFrame, first: int) -> dict[str, np.ndarray]:
    """Features of the rows from ``first`` on, by the definitions of the batch job. NaN stands for no value."""
    close, imb, spread, ticks = (day[c].to_numpy(dtype=float) for c in ("close", "imbalance_last", "spread_mean", "tick_count"))
    out = {f"realized_vol_{n}s": _rolled(close, n, first, _deviations) for n in WINDOWS}
    out |= {f"imbalance_ma_{n}s": _rolled(imb, n, first, _means) for n in MEANS}
    for n in MEANS:
        before = np.concatenate([np.full(n, np.nan), close])[: len(close)]
        before = np.where(before == 0, np.nan, before)
        out[f"price_mom_{n}s"] = ((close - before) / before)[first:]
    sd = _rolled(spread, 300, first, _deviations)
    out["spread_zscore"] = (spread[first:] - _rolled(spread, 300, first, _means)) / np.where(sd > 1e-12, sd, np.nan)
    out["volume_ratio"] = ticks[first:] / _rolled(ticks, 60, first, _means)
    return out


class RollingFeatures(StatefulProcessor):
    """Keeps the last 310 bars of a symbol's day and the last 300 positive volatilities.

    A bar that is not newer than the last one kept came late; it is dropped, as its place in the history is gone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", _BAR)
        self.vols = handle.getListState("vols", "vol double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _BAR.split(", ")]
        hist = pd.DataFrame(list(self.bars.get()), columns=names)
        new = pd.concat([r[names] for r in rows]).sort_values("ts_sec").drop_duplicates("ts_sec")
        if len(hist):
            new = new[new.ts_sec > hist.ts_sec.iloc[-1]]
        vols = deque((v[0] for v in self.vols.get()), maxlen=300)
        for date, day in new.groupby("date", sort=True):
            old = hist[hist.date == date] if len(hist) else hist
            whole = pd.concat([old, day]) if len(old) else day
            feats = _features(whole, len(old))
            sigma = []
            for vol in feats["realized_vol_60s"]:
                if vol > 0:
                    vols.append(float(vol))
                sigma.append(math.fsum(vols) / len(vols) if len(vols) >= 30 else (vols[-1] if vols else 2.0))
            hist = whole.iloc[-KEEP:]
            out = pd.DataFrame({"symbol": key[0], "ts_sec": day.ts_sec.astype("int64"), "date": day.date, "close": day.close.astype(float)})
            for c, values in {**feats, "sigma": sigma}.items():
                values = np.asarray(values, dtype=float)
                out[c] = pd.Series(np.where(np.isnan(values), None, values), index=out.index, dtype=object)
            yield out
        self.bars.put([tuple(r) for r in hist.itertuples(index=False)])
        if vols:
            self.vols.put([(v,) for v in vols])

    def close(self) -> None:
        pass


def rolling_features(bars: DataFrame) -> DataFrame:
    """Rolling features of a bar stream, such as ``bar_stream`` gives. Late bars of a symbol are dropped."""
    d = bars.select("symbol", "ts_sec", "date", "close", "imbalance_last", "spread_mean", "tick_count")
    return d.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=RollingFeatures(), outputStructType=FEATURES, outputMode="Append", timeMode="None")


SIGNAL = "symbol string, generated_at timestamp, expires_at timestamp, mm_action string, widen_factor double, is_default boolean"
NAMES = [c.split()[0] for c in SIGNAL.split(", ")]


BUCKETS = 4096


class LivingSignal(StatefulProcessor):
    """Every change of a symbol's signal, in time order: a newer one, or the neutral default when the last one expires.

    All signals of a batch are gone through, so the changes do not depend on how files fall into batches, as long as
    older signals do not arrive in later batches; those are passed over. A group is a bucket of symbols, whose living
    signals are one list with one timer, for the first of them to expire: every call to the state goes to the JVM and
    back, which for each symbol took longer than the work.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "symbol string, generated_ms long, expires_ms long")

    def _keep(self, live: dict, timer: int | None) -> None:
        """Stores the living signals; ``timer`` is the one that is set."""
        if live:
            self.live.put([(s, *x) for s, x in live.items()])
        else:
            self.live.clear()
        first = min((x[1] for x in live.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cols = ["generated_at", "expires_at", "mm_action", "widen_factor", "symbol"]
        live, out = {s: (born, dies) for s, born, dies in self.live.get()}, []
        timer = min((x[1] for x in live.values()), default=None)
        for r in pd.concat([r[cols] for r in rows]).sort_values(cols[:4]).itertuples(index=False):
            born, dies = (t.value // 1_000_000 for t in (r.generated_at, r.expires_at))
            last = live.get(r.symbol)
            if last is not None and born < last[0]:
                continue  # older than the signal that lives
            if last is not None and born > last[1]:  # it had expired before; the timer would say so later
                out.append((r.symbol, pd.Timestamp(last[1], unit="ms"), None, "NORMAL", 1.0, True))
            live[r.symbol] = born, dies
            out.append((r.symbol, r.generated_at, r.expires_at, r.mm_action, float(r.widen_factor), False))
        if out:
            self._keep(live, timer)
            yield pd.DataFrame(out, columns=NAMES).astype({"expires_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        live = {s: (born, dies) for s, born, dies in self.live.get()}
        gone = {s: dies for s, (_, dies) in live.items() if dies <= at or dies < now}
        self._keep({s: x for s, x in live.items() if s not in gone}, None)  # the timer that fired is gone
        if gone:
            yield pd.DataFrame([(s, pd.Timestamp(dies, unit="ms"), None, "NORMAL", 1.0, True) for s, dies in gone.items()],
                               columns=NAMES).astype({"expires_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def living_signals(signals: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes of the current signal per symbol: a newer signal, or the default when the last one expires."""
    d = signals.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS))).withWatermark("generated_at", late)
    return d.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LivingSignal(), outputStructType=SIGNAL, outputMode="Append", timeMode="EventTime")


def current(changes: DataFrame) -> DataFrame:
    """Last change of every symbol; a default of the same moment wins."""
    return changes.groupBy("symbol").agg(F.max_by(
        F.struct("mm_action", "widen_factor", "is_default"), F.struct("generated_at", "is_default")).alias("_c")).select("symbol", "_c.*")
