"""Column expressions shared by the jobs. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IST offset and session bounds, in seconds.
IST_OFFSET = 19800
EQUITY_SESSION = (33300, 55800)
CURRENCY_SESSION = (32400, 61200)
CURRENCY_PATTERN = "USDINR|EURINR|GBPINR|JPYINR"
OPEN_END = 35100
CLOSE_START = 53100


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str, default: float | None = None) -> Column:
    """NaN and infinities become NULL, or ``default`` when one is given."""
    c = _c(x).cast("double")
    ok = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    return ok if default is None else F.coalesce(ok, F.lit(float(default)))


def finite(x: Column | str) -> Column:
    c = _c(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    b = _c(b)
    return _c(a) / F.when(b != 0, b)


def per_deviation(a: Column | str, sd: Column) -> Column:
    """a / sd, NULL where the deviation is zero up to rounding."""
    return _c(a) / F.when(sd > 1e-12, sd)


def pearson(x: Column | str, y: Column | str, w=None) -> Column:
    """Correlation of the pairs where both are present; NULL where one side is constant."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()

    def over(a):
        return a if w is None else a.over(w)

    sx = over(F.stddev_samp(F.when(both, x)))
    sy = over(F.stddev_samp(F.when(both, y)))
    return over(F.covar_samp(x, y)) / (F.when(sx > 1e-12, sx) * F.when(sy > 1e-12, sy))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Bounds on both sides; a NULL stays NULL."""
    c = _c(x)
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


# ---- time ------------------------------------------------------------------

def ist_tod(ts: Column | str = "ts_sec") -> Column:
    return F.pmod(_c(ts) + IST_OFFSET, F.lit(86400))


def ist_date(ts: Column | str = "ts_sec") -> Column:
    return F.date_from_unix_date(F.floor((_c(ts) + IST_OFFSET) / 86400).cast("int"))


def ist_text(ts: Column | str = "ts_sec") -> Column:
    local = F.from_utc_timestamp(F.timestamp_seconds(_c(ts)), "Asia/Kolkata")
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def hhmm(tod: Column | str) -> Column:
    t = _c(tod)
    return F.format_string("%02d:%02d", F.floor(t / 3600), F.floor((t % 3600) / 60))


def in_session(symbol: Column | str = "symbol", tod: Column | None = None) -> Column:
    t = ist_tod() if tod is None else tod
    return F.when(
        _c(symbol).rlike(CURRENCY_PATTERN), t.between(*CURRENCY_SESSION)
    ).otherwise(t.between(*EQUITY_SESSION))


def session_label(tod: Column) -> Column:
    return F.when(tod < OPEN_END, "open").when(tod >= CLOSE_START, "close").otherwise("midday")


def time_of_day(df):
    """Time-of-day columns of a bar table."""
    t = ist_tod()
    return df.withColumns({
        "ist_tod_sec": t,
        "ist_hhmm": hhmm(t),
        "bucket_15m": hhmm(F.floor(t / 900) * 900),
        "bucket_30m": hhmm(F.floor(t / 1800) * 1800),
        "session": session_label(t),
    })


# ---- book ------------------------------------------------------------------

def weighted_mid(bp="bid_p1", bq="bid_q1", ap="ask_p1", aq="ask_q1") -> Column:
    b, a = _c(bq), _c(aq)
    return ratio(_c(bp) * a + _c(ap) * b, b + a)


def mid_or_close() -> Column:
    return F.coalesce(F.col("weighted_mid"), F.col("close"))


def imbalance(b: Column | str, a: Column | str) -> Column:
    return F.coalesce(ratio(_c(b) - _c(a), _c(b) + _c(a)), F.lit(0.0))
