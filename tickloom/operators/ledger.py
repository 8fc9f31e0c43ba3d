"""Costs, positions and results from a table of fills."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.blocks import chained, ordered, runs
from tickloom.operators.scans import running
from tickloom.session import stage

# Rates per instrument type, brokerage in rupees per order.
RATES = {
    "equity_futures": {"stt": 0.0005, "exchange": 0.0000173, "sebi": 0.000001, "stamp": 0.00002, "brokerage": 20.0},
    "currency_futures": {"stt": 0.0, "exchange": 0.000009, "sebi": 0.000001, "stamp": 0.00001, "brokerage": 20.0},
    "equity_options": {"stt": 0.0005, "exchange": 0.0000353, "sebi": 0.000001, "stamp": 0.00003, "brokerage": 20.0},
    "currency_options": {"stt": 0.0, "exchange": 0.000009, "sebi": 0.000001, "stamp": 0.00001, "brokerage": 20.0},
}
GST = 0.18


def _rate(kind: str) -> Column:
    pairs = [F.lit(x) for name, r in RATES.items() for x in (name, r[kind])]
    return F.create_map(*pairs)[F.col("instrument_type")]


def with_costs(fills: DataFrame) -> DataFrame:
    """Cost of each fill by component; the tax on sales and the stamp on purchases."""
    value = F.col("price") * F.col("quantity") * F.col("lot_size")
    sell = F.col("side") == "SELL"
    d = fills.withColumns({
        "stt": F.when(sell, value * _rate("stt")).otherwise(0.0),
        "stamp": F.when(sell, 0.0).otherwise(value * _rate("stamp")),
        "exchange": value * _rate("exchange"), "sebi": value * _rate("sebi"), "brokerage": _rate("brokerage")})
    gst = (F.col("brokerage") + F.col("exchange") + F.col("sebi")) * GST
    total = sum((F.col(c) for c in ("stt", "exchange", "sebi", "gst", "brokerage", "stamp")), F.lit(0.0))
    return d.withColumn("gst", gst).withColumn("cost", total)


def round_trip(fills: DataFrame) -> DataFrame:
    """Cost of buying and selling at the fill price, and the spread that pays for it."""
    value = F.col("price") * F.col("quantity") * F.col("lot_size")
    one = _rate("brokerage") + value * (_rate("exchange") + _rate("sebi"))
    cost = 2 * one * (1 + GST) + value * (_rate("stt") + _rate("stamp"))
    return fills.withColumn("round_trip", cost).withColumn(
        "breakeven_spread", F.col("round_trip") / (F.col("quantity") * F.col("lot_size")))


METRICS = (
    "total_fills long, buy_fills long, sell_fills long, gross_pnl double, total_costs double, net_pnl double, "
    "sharpe double, max_drawdown double, win_rate double, max_inventory long, final_inventory long")


def _path(buy, qty, inv: int, price=None, basis: float = 0.0, lot=None):
    """Average-cost book that realises sales while inventory is positive: (slope, basis, results of sales).

    The basis after the fills is slope * (basis before) + what it is for a basis of zero.
    """
    slope, sales = 1.0, []
    for i in range(len(buy)):
        q, p = qty[i], price[i]
        if buy[i]:
            basis += p * q
            inv += q
        elif inv > 0:
            avg = basis / inv
            if lot is not None:
                sales.append((p - avg) * q * lot[i])
            basis -= avg * q
            slope *= 1 - q / inv
            inv -= q
    return slope, basis, sales


def inventory_after(buy: np.ndarray, qty: np.ndarray, low: int, high: int, every: int = 1024) -> np.ndarray:
    """The inventory after the fills for each inventory from ``low`` to ``high`` before them.

    A sale lowers only positive inventories, so the map breaks into pieces wherever a path touches zero. Paths that
    have met stay together: they are looked for after ``every`` fills and followed once from there.
    """
    values = np.arange(low, high + 1, dtype=np.int64)
    back, shift = np.arange(len(values)), 0  # purchases raise all values: they are kept as one number
    for i, (up, q) in enumerate(zip(buy.tolist(), qty.tolist())):
        if up:
            shift += q
        else:
            values[values > -shift] -= q
        if i % every == every - 1:
            values, own = np.unique(values, return_inverse=True)
            back = own[back]
    return (values + shift)[back]


_BLOCK = ("symbol string, date date, _blk long, fills long, buys long, costs double, net long, low long, high long, "
          "largest long, buy array<boolean>, qty array<long>, price array<double>, lot array<double>")


def _session_blocks(fills: DataFrame, order: list[str], rows: int) -> DataFrame:
    """A row for each run of a session's fills: counts, costs, extremes of the signed path, and the fills as arrays."""
    keys = ["symbol", "date"]
    slim = with_costs(fills).select(
        *keys, *[c for c in order if c not in keys], "side", F.col("price").cast("double").alias("price"),
        F.col("quantity").cast("long").alias("quantity"), F.col("lot_size").cast("double").alias("lot_size"), "cost")

    def block(pdf):
        side, qty, cost = (pdf[c].to_numpy() for c in ("side", "quantity", "cost"))
        buy = side == "BUY"
        path = np.cumsum(np.where(buy, qty, -qty))
        return (pdf["symbol"].iat[0], pdf["date"].iat[0], int(pdf["_pos"].iat[0]), len(pdf), int(buy.sum()), cost.sum(),
                int(path[-1]), int(path.min()), int(path.max()), int(qty[~buy].max(initial=0)), buy, qty,
                pdf["price"].to_numpy(), pdf["lot_size"].to_numpy())

    def cut(frames):
        for made in runs(frames, keys, rows):
            yield pd.DataFrame([block(pdf) for pdf in made], columns=names)

    names = [c.split()[0] for c in _BLOCK.split(", ")]
    sorted_fills = ordered(slim, keys, [c for c in order if c not in keys])
    return stage(sorted_fills.mapInPandas(cut, _BLOCK), "session-blocks")


def _session_starts(blocks: DataFrame) -> DataFrame | None:
    """(_blk, inv, basis) at the start of every block of sessions with several; None without such a session.

    The start's inventory is at least one more than minus the largest sale, and at most that of the same path cut off
    at zero. For these values a block tabulates what its fills make of them; beyond the depth of its own path all
    sales count. The tables are chained for the inventories; with those known a block is a linear map of the basis,
    and these maps are chained.
    """
    keys = ["symbol", "date"]
    if blocks.groupBy(*keys).count().where("count > 1").isEmpty():
        return None
    session = Window.partitionBy("symbol", "date")
    before = session.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    deep = F.least("low", F.lit(0))
    sums = blocks.select("symbol", "date", "_blk", "net", deep.alias("deep"), "largest").withColumns({
        "_n": F.count(F.lit(1)).over(session), "_sum": F.coalesce(F.sum("net").over(before), F.lit(0)),
        "_big": F.coalesce(F.max("largest").over(before), F.lit(0))})
    sums = sums.where("_n > 1").withColumn("_cut", -F.col("deep") - F.col("_sum"))
    top = F.col("_sum") + F.greatest(F.coalesce(F.max("_cut").over(before), F.lit(0)), F.lit(0))
    asked = sums.select(
        "symbol", "date", "_blk", "net", "deep", F.least(F.lit(0), 1 - F.col("_big")).alias("_from"),
        F.greatest(F.least(top, -F.col("deep")), F.lit(0)).alias("_to"))
    arrays = blocks.select("_blk", "buy", "qty", "price", "lot")

    def tabulate(frames):
        for pdf in frames:
            made = [inventory_after(*r) for r in zip(pdf["buy"], pdf["qty"], pdf["_from"], pdf["_to"])]
            yield pdf.drop(columns=["buy", "qty"]).assign(after=made)

    tables = asked.join(arrays.select("_blk", "buy", "qty"), "_blk").select(
        "symbol", "date", "_blk", "net", "deep", "_from", "_to", "buy", "qty").mapInPandas(
        tabulate, "symbol string, date date, _blk long, net long, deep long, _from long, _to long, after array<long>")

    starts = chained(
        tables.withColumnsRenamed({"_blk": "blk", "_from": "lowest", "_to": "highest"}).select(
            *keys, "blk", "net", "lowest", "highest", "after"),
        keys, "blk", "symbol string, date date, blk long, inv long", lambda: 0, _followed)
    starts = stage(starts, "inventories")

    def reduce_basis(frames):
        for pdf in frames:
            maps = [_path(b, q, int(i), p)[:2] for b, q, i, p in zip(pdf["buy"], pdf["qty"], pdf["inv"], pdf["price"])]
            yield pdf[["symbol", "date", "blk", "inv"]].assign(slope=[m[0] for m in maps], shift=[m[1] for m in maps])

    maps = starts.join(arrays.drop("lot").withColumnRenamed("_blk", "blk"), "blk").select(
        *keys, "blk", "inv", "buy", "qty", "price").mapInPandas(
        reduce_basis, "symbol string, date date, blk long, inv long, slope double, shift double")
    return chained(maps, keys, "blk", "_blk long, inv long, basis double", lambda: 0.0, lambda basis, r: (
        r.slope * basis + r.shift, (r.blk, r.inv, basis)))


def _followed(inv, r):
    after = inv + r.net if inv > r.highest else int(r.after[inv - r.lowest])
    return after, (r.symbol, r.date, r.blk, inv)


_PART = ("symbol string, date date, _blk long, fills long, buys long, costs double, net long, low long, high long, "
         "sales long, first double, mean double, m2 double, wins long, total double, top double, bottom double, worst double")


def _part(r) -> tuple:
    """What a block adds to its session: moments of the results of all sales but its first, and the running result's
    highest, lowest and worst fall from a high."""
    pnl = np.array(_path(r.buy, r.qty, int(r.inv), r.price, r.basis, r.lot)[2])
    own = (r.symbol, r.date, r.blk, r.fills, r.buys, r.costs, r.net, r.low, r.high, len(pnl))
    if not len(pnl):
        return (*own, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0)
    run, rest = np.cumsum(pnl), pnl[1:]
    mean = rest.mean() if len(rest) else 0.0
    return (*own, pnl[0], mean, ((rest - mean) ** 2).sum(), int((rest > 0).sum()), run[-1], run.max(), run.min(),
            (run - np.maximum.accumulate(run)).min())


class _Session:
    """Merges the parts of a session in their order."""

    def __init__(self):
        self.fills = self.buys = self.path = self.peak = self.k = self.wins = 0
        self.costs = self.real = self.mean = self.m2 = self.fall = 0.0
        self.top = None

    def add(self, r) -> _Session:
        self.fills, self.buys, self.costs = self.fills + r.fills, self.buys + r.buys, self.costs + r.costs
        self.peak = max(self.peak, abs(self.path + r.low), abs(self.path + r.high))
        self.path += r.net
        if r.sales:
            self._moments(r.sales - 1, r.mean, r.m2, r.wins)
            if self.top is not None:
                self._moments(1, r.first, 0.0, r.first > 0)
                self.fall = min(self.fall, self.real + r.bottom - self.top)
            self.fall = min(self.fall, r.worst)
            self.top = self.real + r.top if self.top is None else max(self.top, self.real + r.top)
            self.real += r.total
        return self

    def _moments(self, n, mean, m2, wins):
        if n:
            gap, both = mean - self.mean, self.k + n
            self.m2 += m2 + gap * gap * self.k * n / both
            self.mean += gap * n / both
            self.k, self.wins = both, self.wins + wins

    def line(self):
        sd = math.sqrt(self.m2 / self.k) if self.k else 0.0
        sd = sd if sd > 1e-12 * max(1.0, abs(self.mean)) else 0.0  # equal results differ by rounding only
        return (self.fills, self.buys, self.fills - self.buys, self.real, self.costs, self.real - self.costs,
                self.mean / sd * math.sqrt(252) if sd > 0 else 0.0, self.fall,
                self.wins / self.k if self.k else 0.0, self.peak, self.path)


def session_metrics(fills: DataFrame, order: list[str], block_rows: int = 20_000) -> DataFrame:
    """Result of every (symbol, date): gross, costs, net, Sharpe, drawdown, win rate, inventory.

    Whether a sale counts depends on the inventory that all fills before it left. A session is cut into blocks by a
    range-partitioned sort; what a block makes of an inventory and of a basis before it are maps that are chained, so
    every block then knows its start and all are evaluated in parallel. Counts, moments and drawdowns of the blocks
    merge. Through one task goes a session's list of blocks, never its fills.
    """
    blocks = _session_blocks(fills, order, block_rows)
    starts = _session_starts(blocks)
    known = blocks if starts is None else blocks.join(starts, "_blk", "left")
    inv, basis = (F.lit(None) if starts is None else F.col(c) for c in ("inv", "basis"))
    known = known.withColumns({"inv": F.coalesce(inv, F.lit(0)), "basis": F.coalesce(basis, F.lit(0.0))}).withColumnRenamed("_blk", "blk")

    def evaluate(frames):
        for pdf in frames:
            yield pd.DataFrame([_part(r) for r in pdf.itertuples(index=False)], columns=names)

    names = [c.split()[0] for c in _PART.split(", ")]
    parts = known.mapInPandas(evaluate, _PART)
    keys = ["symbol", "date"]

    def merge(frames):
        key = session = None
        for pdf in frames:
            done = []
            for r in pdf.itertuples(index=False):
                if (r.symbol, r.date) != key:
                    if session is not None:
                        done.append((*key, *session.line()))
                    key, session = (r.symbol, r.date), _Session()
                session.add(r)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if session is not None:
            yield pd.DataFrame([(*key, *session.line())], columns=columns)

    schema = f"symbol string, date date, {METRICS}"
    columns = [c.split()[0] for c in schema.split(", ")]
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_blk").mapInPandas(merge, schema)


# ---- positions with flips --------------------------------------------------------

def _walk(lots, avg, real, signed, price, lot, emit):
    """Average price and realised result through one block of fills.

    Returns (lots, slope, avg, gain, real): for another average before the block the one behind it changes by slope
    times the difference, and the result by gain times it. A reduction keeps the average, an increase blends it with
    the price, and a flip replaces it.
    """
    slope, gain = 1.0, 0.0
    for i in range(len(signed)):
        q, p = signed[i], price[i]
        pnl = 0.0
        after = lots + q
        if lots * q >= 0:
            w = abs(lots) / abs(after) if after else 0.0
            avg = avg * w + p * (1 - w)
            slope *= w
        else:
            shut = min(abs(q), abs(lots)) * lot[i] * (1 if lots > 0 else -1)
            pnl = (p - avg) * shut
            gain -= slope * shut
            if abs(q) > abs(lots):
                avg, slope = p, 0.0
        lots = after
        real += pnl
        if emit is not None:
            emit.append((lots, avg if lots else 0.0, pnl, real))
    return lots, slope, avg, gain, real


FEW = 500_000


def _few(df: DataFrame, name: str) -> DataFrame | None:
    """A staged table to join with, broadcast if it is counted to be small; None if it is empty."""
    df = stage(df, name)
    n = df.count()
    return (F.broadcast(df) if n <= FEW else df) if n else None


def _flat(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()


def position_ledger(fills: DataFrame, order: list[str], block_rows: int = 20_000) -> DataFrame:
    """Net lots, average price and realised result after every fill, long and short; ``_pos`` grows along a symbol.

    Fills are sorted once, by ranges; a run of one symbol's fills in an Arrow batch is a block, kept as one row of arrays
    and never shuffled again. Most symbols are one block and start flat. For the others the lots before a block are a sum
    over the blocks before it, each block reduces to linear maps of the average price and of the result, and the maps of a
    symbol are chained. Then every block is walked from its start. ``_blk`` and ``_top`` are the block and the highest
    result in it so far.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).cast("long")
    d = ordered(fills.withColumn("_q", signed), ["symbol"], [c for c in order if c != "symbol"])
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    own = [c for c in kinds if c != "_q"]
    lists = [c for c in kinds if c != "symbol"]

    def cut(batches):
        for batch in batches:
            if not len(batch):
                continue
            symbol, q = batch.column("symbol"), batch.column("_q").to_numpy(zero_copy_only=False)
            names = symbol.to_numpy(zero_copy_only=False)
            run = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            ends = np.append(run[1:], len(batch))
            starts = np.concatenate([np.arange(a, b, block_rows) for a, b in zip(run, ends)])
            offsets = pa.array(np.append(starts, len(batch)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [symbol.take(pa.array(starts)), batch.column("_pos").take(pa.array(starts)), pa.array(np.add.reduceat(q, starts), pa.int64()),
                 *[pa.ListArray.from_arrays(offsets, batch.column(c)) for c in lists]], names=["symbol", "_blk", "_net", *lists])

    shape = "symbol string, _blk long, _net long, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in lists)
    # a reader holds a row group's arrays at once
    blocks = stage(d.mapInArrow(cut, shape), "fill-blocks", **{"parquet.block.size": 16 << 20})
    symbol = Window.partitionBy("symbol")
    upto = symbol.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    several = _few(blocks.select("symbol", "_blk", "_net").withColumns({
        "_n": F.count(F.lit(1)).over(symbol), "_lots0": F.coalesce(F.sum("_net").over(upto), F.lit(0))}).where(
        "_n > 1").select("_blk", "_lots0"), "lots")

    def legs(batch):
        """(row, signed quantities, prices, lot sizes) of each block of a batch."""
        ends = np.cumsum(batch.column("_q").value_lengths().to_numpy()).tolist()
        q, price, lot = batch.column("_q").flatten().to_numpy().tolist(), _flat(batch, "price"), _flat(batch, "lot_size")
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            yield i, (q[a:b], price[a:b], lot[a:b])

    def reduce_blocks(batches):
        for batch in batches:
            lots0, made = batch.column("lots0").to_pylist(), []
            for i, own_legs in legs(batch):
                made.append(_walk(lots0[i], 0.0, 0.0, *own_legs, None)[1:])
            slope, shift, gain, real = zip(*made) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbol"), batch.column("blk"), batch.column("lots0"), *[pa.array(x, pa.float64()) for x in (slope, shift, gain, real)]],
                names=["symbol", "blk", "lots0", "slope", "shift", "gain", "real"])

    def follow(state, r):
        avg, real = state
        return (r.slope * avg + r.shift, real + r.real + r.gain * avg), (r.blk, r.lots0, avg, real)

    start = ["_lots0", "_avg0", "_real0"]
    zero = dict(zip(start, (F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0))))
    if several is None:
        known = blocks.withColumns(zero)
    else:
        maps = blocks.select("symbol", "_blk", "_q", "price", "lot_size").join(several, "_blk").withColumnsRenamed(
            {"_blk": "blk", "_lots0": "lots0"}).mapInArrow(
            reduce_blocks, "symbol string, blk long, lots0 long, slope double, shift double, gain double, real double")
        starts = _few(chained(maps, ["symbol"], "blk", "_blk long, _lots0 long, _avg0 double, _real0 double", lambda: (0.0, 0.0), follow), "starts")
        known = blocks.join(starts, "_blk", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items()})

    def walk_blocks(batches):
        for batch in batches:
            starts = list(zip(*[batch.column(c).to_pylist() for c in start]))
            made, tops = [], []
            for i, own_legs in legs(batch):
                first = len(made)
                _walk(*starts[i], *own_legs, made)
                tops.append(np.maximum.accumulate([m[3] for m in made[first:]]))
            if not made:
                continue
            row = np.repeat(np.arange(len(batch)), batch.column("_q").value_lengths().to_numpy())
            columns = [batch.column("symbol").take(pa.array(row)) if c == "symbol" else batch.column(c).flatten() for c in own]
            added = [pa.array(x, pa.int64() if k == 0 else pa.float64()) for k, x in enumerate(zip(*made))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *added, batch.column("_blk").take(pa.array(row)), pa.array(np.concatenate(tops), pa.float64())], names=names)

    names = [*own, "lots", "avg_price", "pnl", "realized_pnl", "_blk", "_top"]
    return known.mapInArrow(walk_blocks, ", ".join(f"`{c}` {kinds[c]}" for c in own) +
                            ", lots long, avg_price double, pnl double, realized_pnl double, _blk long, _top double")


def mark_to_market(ledger: DataFrame, last_prices: DataFrame | None = None) -> DataFrame:
    """Last position of each symbol valued at its last price (the last fill where none is given)."""
    pos = ledger.groupBy("symbol").agg(F.max_by(
        F.struct("lots", "avg_price", "realized_pnl", "price", "lot_size"), "_pos").alias("_l")).select("symbol", "_l.*")
    if last_prices is not None:
        pos = pos.join(last_prices.select("symbol", F.col("last_price").alias("_mark")), "symbol", "left")
        pos = pos.withColumn("price", F.coalesce("_mark", "price")).drop("_mark")
    open_pnl = F.when(F.col("lots") != 0, (F.col("price") - F.col("avg_price")) * F.col("lots") * F.col("lot_size")).otherwise(0.0)
    return pos.withColumn("unrealized_pnl", open_pnl).withColumn(
        "total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl"))


def drawdown(ledger: DataFrame) -> DataFrame:
    """Running peak of the realised result of a position ledger and the distance from it.

    Within a block the ledger has it; what is joined are the peaks of the blocks before, of symbols with several blocks.
    """
    symbol = Window.partitionBy("symbol")
    upto = symbol.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = _few(ledger.groupBy("symbol", "_blk").agg(F.max("_top").alias("_m")).withColumns({
        "_n": F.count(F.lit(1)).over(symbol), "_high": F.max("_m").over(upto)}).where("_n > 1").select("_blk", "_high"), "peaks")
    d = ledger.withColumn("_high", F.lit(None).cast("double")) if before is None else ledger.join(before, "_blk", "left")
    d = d.withColumn("peak", F.greatest("_high", "_top")).drop("_high")
    return d.withColumn("drawdown", F.col("realized_pnl") - F.col("peak"))


def inventory_path(fills: DataFrame, order: list[str], chunk: str = "date") -> DataFrame:
    """Signed inventory after every fill and the largest absolute inventory so far."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    d = running(fills.withColumn("_q", signed), ["symbol"], chunk, order, {"inventory": ("sum", "_q")})
    d = d.withColumn("_abs", F.abs("inventory"))
    return running(d, ["symbol"], chunk, order, {"max_inventory": ("max", "_abs")}).drop("_q", "_abs")


# ---- option book -------------------------------------------------------------------

def net_delta(fills: DataFrame, deltas: DataFrame, lot_size: int, threshold: float, max_lots: int) -> DataFrame:
    """Delta of the option book of each underlying whenever it changes, and the hedge it asks for.

    ``fills``: underlying, symbol, date, ts_sec, side, lots. ``deltas``: underlying,
    symbol, date, ts_sec, delta. Each option yields its change of lots x delta; the
    changes of an underlying are then summed over time, so no grid of options by
    seconds is built. Positions start flat each day.
    """
    signed = F.when(F.col("side") == "BUY", F.col("lots")).otherwise(-F.col("lots")).cast("double")
    cols = ["underlying", "symbol", "date", "ts_sec"]
    ev = fills.select(*cols, signed.alias("dl"), F.lit(None).cast("double").alias("delta")).unionByName(
        deltas.select(*cols, F.lit(0.0).alias("dl"), "delta"))
    ev = ev.groupBy(*cols).agg(F.sum("dl").alias("dl"), F.max("delta").alias("delta"))
    w = Window.partitionBy("symbol", "date").orderBy("ts_sec")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum("dl").over(upto) * F.coalesce(F.last("delta", ignorenulls=True).over(upto), F.lit(0.0)) * lot_size
    ev = ev.withColumn("_c", held).withColumn("_d", F.col("_c") - F.lag("_c", 1, 0.0).over(w))
    u = ev.groupBy("underlying", "date", "ts_sec").agg(F.sum("_d").alias("_d"))
    day = Window.partitionBy("underlying", "date").orderBy("ts_sec").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("net_delta", F.sum("_d").over(day)).drop("_d")
    size = F.least(F.floor(F.abs("net_delta") / lot_size + 1e-9), F.lit(max_lots))
    need = (F.abs("net_delta") > threshold) & (size > 0)
    return u.withColumns({
        "hedge_lots": F.when(need, size).otherwise(0),
        "hedge_side": F.when(need, F.when(F.col("net_delta") > 0, "SELL").otherwise("BUY"))})
