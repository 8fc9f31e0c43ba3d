"""Contract symbols, expiries and the trading calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_MON = "|".join(MONTHS)
SUFFIX = rf"(?i)\d{{2}}({_MON})FUT$"
FUTURE = rf"(?i)^(.*?)(\d{{2}})({_MON})FUT$"
MONTHLY_OPTION = rf"^([A-Z&-]+?)(\d{{2}})({_MON})(\d+(?:\.\d+)?)(CE|PE)$"
WEEKLY_OPTION = r"^([A-Z&-]+?)(\d{2})([1-9OND])(\d{2})(\d+(?:\.\d+)?)(CE|PE)$"
INDEX_BASES = ("NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "SENSEX", "NIFTYNXT50")

# Exchange expiry dates of 2026, moved where the last Thursday is a holiday.
EXPIRY_2026 = (
    "2026-01-29", "2026-02-26", "2026-03-26", "2026-04-23", "2026-05-26", "2026-06-25",
    "2026-07-30", "2026-08-27", "2026-09-24", "2026-10-29", "2026-11-26", "2026-12-31",
)
# Exchange holidays of 2026.
HOLIDAYS_2026 = (
    "2026-01-26", "2026-03-25", "2026-04-02", "2026-04-03", "2026-04-14", "2026-05-01", "2026-08-15",
    "2026-10-02", "2026-10-22", "2026-11-11", "2026-11-12", "2026-11-25", "2026-12-25",
)


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def strip_contract(symbol: Column | str) -> Column:
    return F.regexp_replace(_c(symbol), SUFFIX, "")


def month_number(mon: Column) -> Column:
    return (F.instr(F.lit("".join(MONTHS)), F.upper(mon)) + 2) / 3


def _month_start(yy: Column, mon: Column) -> Column:
    m = month_number(mon).cast("int")
    return F.when(mon != "", F.make_date(F.lit(2000) + yy.try_cast("int"), F.when(m.between(1, 12), m), F.lit(1)))


def last_thursday(day: Column) -> Column:
    return F.next_day(F.date_sub(F.last_day(day), 7), "THU")


def contract_month(symbol: Column | str) -> Column:
    s = _c(symbol)
    return _month_start(F.regexp_extract(s, FUTURE, 2), F.regexp_extract(s, FUTURE, 3))


def contract_expiry(month: Column, overrides: tuple[str, ...] = EXPIRY_2026) -> Column:
    """Expiry of the contract month: a listed date, else the last Thursday."""
    listed = F.create_map(*[F.lit(x) for d in overrides for x in (d[:7], d)])
    return F.coalesce(listed[F.date_format(month, "yyyy-MM")].cast("date"), last_thursday(month))


def previous_contract(symbol: Column | str) -> Column:
    """The contract one month earlier; NULL for other symbols."""
    s = _c(symbol)
    prev = F.add_months(contract_month(s), -1)
    return F.concat(F.regexp_extract(s, FUTURE, 1), F.date_format(prev, "yy"),
                    F.upper(F.date_format(prev, "MMM")), F.lit("FUT"))


def parse_options(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Adds underlying, strike, opt_type and expiry; symbols of neither form get NULLs."""
    s = F.col(symbol)
    mon, week = s.rlike(MONTHLY_OPTION), s.rlike(WEEKLY_OPTION)

    def part(m_idx, w_idx):
        return F.when(mon, F.regexp_extract(s, MONTHLY_OPTION, m_idx)).when(
            week, F.regexp_extract(s, WEEKLY_OPTION, w_idx))

    code = F.regexp_extract(s, WEEKLY_OPTION, 3)
    wm = F.when(code == "O", 10).when(code == "N", 11).when(code == "D", 12).otherwise(code.try_cast("int"))
    weekly = F.try_to_timestamp(F.concat_ws(
        "-", F.concat(F.lit("20"), F.regexp_extract(s, WEEKLY_OPTION, 2)), F.lpad(wm.cast("string"), 2, "0"),
        F.regexp_extract(s, WEEKLY_OPTION, 4)), F.lit("yyyy-MM-dd")).cast("date")
    monthly = last_thursday(_month_start(
        F.regexp_extract(s, MONTHLY_OPTION, 2), F.regexp_extract(s, MONTHLY_OPTION, 3)))
    return df.withColumns({
        "underlying": part(1, 1), "strike": part(4, 5).try_cast("double"), "opt_type": part(5, 6),
        "expiry": F.when(mon, monthly).when(week, weekly)})


def instrument_class(symbol: Column | str) -> Column:
    s = _c(symbol)
    base = strip_contract(s)
    return (
        F.when(s.rlike("^(USDINR|EURINR|GBPINR|JPYINR)"), "CURRENCY")
        .when(s.endswith("_SPOT"), "SPOT")
        .when(s.rlike(r"\d(CE)$"), "CE").when(s.rlike(r"\d(PE)$"), "PE")
        .when(s.rlike(SUFFIX) & base.isin(*INDEX_BASES), "INDEX_FUT")
        .when(s.rlike(SUFFIX), "FUT").otherwise("EQUITY")
    )


# ---- calendar ----------------------------------------------------------------

def current_month(day: Column) -> Column:
    """First day of the month whose contract trades on ``day``."""
    start = F.trunc(day, "MM")
    return F.when(day > contract_expiry(start), F.add_months(start, 1)).otherwise(start)


def contract_name(month: Column) -> Column:
    return F.concat(F.upper(F.date_format(month, "MMM")), F.lit("FUT"))


def roll_days(dates: DataFrame) -> DataFrame:
    """Current contract of each date and whether it differs from the previous weekday's."""
    d = F.col("date")
    dow = F.dayofweek(d)
    before = F.date_sub(d, F.when(dow == 2, 3).when(dow == 1, 2).otherwise(1))
    return dates.withColumns({
        "contract": contract_name(current_month(d)), "old_contract": contract_name(current_month(before)),
    }).withColumn("is_roll_day", F.col("contract") != F.col("old_contract"))


def holidays(spark: SparkSession, days=HOLIDAYS_2026) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date").alias("day"))


def recent_trading_dates(as_of: DataFrame, closed: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` weekdays before each date that are no holidays, newest first; always ``n`` of them.

    ``closed`` is a calendar, some days a year: even if all of its days fell into the stretch, that would hold enough.
    """
    reach = math.ceil((n + closed.distinct().count()) * 7 / 5) + 2
    d = as_of.withColumn("day", F.explode(F.sequence(F.date_sub("date", reach), F.date_sub("date", 1))))
    d = d.where(~F.dayofweek("day").isin(1, 7)).join(closed, "day", "left_anti")
    w = Window.partitionBy("date").orderBy(F.desc("day"))
    return d.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
