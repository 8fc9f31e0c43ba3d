"""Ordered sequences of any length as blocks: cut in parallel, chained by their summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, keys: list[str], order: list[str], name: str = "_pos") -> DataFrame:
    """``df`` sorted by range partitions, with a number that grows along ``keys`` and ``order`` (with gaps).

    The ranges are of the whole order, so a key with a large share of the rows is sorted by several tasks.
    """
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(
        name, F.monotonically_increasing_id())


def runs(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[list[pd.DataFrame]]:
    """Consecutive rows of one key, ``rows`` at most, from a stream of sorted frames: lists of whole runs, one a frame."""
    waiting, held, last = [], 0, None

    def whole():
        return waiting[0] if len(waiting) == 1 else pd.concat(waiting, ignore_index=True)

    for pdf in frames:
        if not len(pdf):
            continue
        done, names = [], pdf[keys]
        new = (names.ne(names.shift()) & ~(names.isna() & names.shift().isna())).any(axis=1).to_numpy()
        starts = [0, *[i for i in new.nonzero()[0].tolist() if i], len(pdf)]
        values = list(zip(*[names[k].iloc[starts[:-1]].tolist() for k in keys]))
        for key, a, b in zip(values, starts, starts[1:]):
            key = tuple(None if v is None or v != v else v for v in key)
            if waiting and key != last:
                done.append(whole())
                waiting, held = [], 0
            last = key
            while a < b:
                take = min(b - a, rows - held)
                waiting.append(pdf.iloc[a:a + take])
                a, held = a + take, held + take
                if held == rows:
                    done.append(whole())
                    waiting, held = [], 0
        yield done
    if waiting:
        yield [whole()]


def chained(blocks: DataFrame, keys: list[str], order: str, schema: str, begin: Callable, step: Callable) -> DataFrame:
    """Passes a state along the summaries of each key's blocks: ``step(state, row)`` returns the next state and a row.

    One row per block goes through a task, not the rows in it.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(frames):
        key = state = None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, begin()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return blocks.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(walk, schema)
