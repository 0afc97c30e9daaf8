"""Calendar columns: month ends, business days, 30E/360 and accrued interest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(day: Column) -> Column:
    return F.last_day(day)


def month_index(day: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(day) * 12 + F.month(day) - 1


def shift_month_end(day: Column, months: int) -> Column:
    """The month end ``months`` later."""
    return F.last_day(F.add_months(day, months))


def adjacent(earlier: Column, later: Column) -> Column:
    """Whether ``later`` is in the month right after that of ``earlier``."""
    return month_index(later) - month_index(earlier) == 1


def days_30e_360(start: Column, end: Column) -> Column:
    """Days between two dates when every month has 30: a 31st counts as a 30th on either side."""
    day = lambda d: F.least(F.day(d), F.lit(30))
    return (F.year(end) - F.year(start)) * 360 + (F.month(end) - F.month(start)) * 30 + day(end) - day(start)


def clamped_date(index: Column, day: Column) -> Column:
    """The date in the month of ``index`` with ``day``, or the month's last day if it is shorter."""
    first = F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_add(first, F.least(day, F.day(F.last_day(first))).cast("int") - 1)


def business_number(day: Column) -> Column:
    """Business days (Monday to Friday) before ``day`` since a fixed Monday; differences count them half-open."""
    n = F.unix_date(day) - 4
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_gap(start: Column, end: Column) -> Column:
    """Business days from ``start`` on and before ``end``."""
    return business_number(end) - business_number(start)


def business_days(day: Column) -> Column:
    """The business days of the month of ``day`` as an array."""
    every = F.sequence(F.trunc(day, "month"), F.last_day(day))
    return F.filter(every, lambda d: F.weekday(d) < 5)


def nth_business_day(day: Column, n: int) -> Column:
    """The n-th business day of the month of ``day``, from its end if n is negative; the last there is if it has fewer."""
    days = business_days(day)
    place = F.least(F.lit(abs(n)), F.size(days))
    return F.element_at(days, place if n > 0 else -place)


def accrued(asof: Column, maturity: Column, coupon: Column, frequency: Column, default: Column | None = None) -> tuple[Column, Column]:
    """Accrued interest at a month end, and the coupon paid in its month, per 100 of par.

    Coupon months lie a whole number of periods from the maturity's; interest accrues by 30E/360 from the maturity's
    day in the last of them.  Both are zero without a coupon, a frequency of 1, 2, 4 or 12 a year or a maturity, after
    the month of the maturity, and from the month of the default on.
    """
    now, last = month_index(asof), month_index(maturity)
    paying = (coupon > 0) & frequency.isin(1, 2, 4, 12) & (now <= last)
    if default is not None:
        paying = paying & (default.isNull() | (now < month_index(default)))
    since = F.pmod(now - last, F.try_divide(F.lit(12), frequency).cast("int"))
    days = days_30e_360(clamped_date(now - since, F.day(maturity)), asof)
    return F.when(paying, coupon * days / 360.0).otherwise(0.0), F.when(paying & (since == 0), coupon / frequency).otherwise(0.0)


def year_month(value: Column) -> Column:
    """yyyy-MM from a date string or a yyyymm number; null if neither."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^\d{6}(\.0)?$"), F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2)))
    return F.coalesce(number, F.date_format(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), "yyyy-MM"))
