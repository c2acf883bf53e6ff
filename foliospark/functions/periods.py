"""Dates, fiscal years, intervals and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVER, NEVER = "0001-01-01", "9999-12-31"


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Closed intervals meet; null is unbounded."""
    return (F.coalesce(a_from, day(EVER)) <= F.coalesce(b_to, day(NEVER))) & (F.coalesce(b_from, day(EVER)) <= F.coalesce(a_to, day(NEVER)))


def fiscal_year(d: Column, first_month: Column | int) -> Column:
    """the year in which a fiscal year begins."""
    m = first_month if isinstance(first_month, Column) else F.lit(first_month)
    return F.when((m == 1) | (F.month(d) >= m), F.year(d)).otherwise(F.year(d) - 1)


def fiscal_start(year: Column, first_month: Column) -> Column:
    return F.make_date(year, first_month, F.lit(1))


def fiscal_end(year: Column, first_month: Column) -> Column:
    return F.date_sub(F.make_date(year + 1, first_month, F.lit(1)), 1)


def overlaps_year(valid_from: Column, valid_to: Column, year: Column, first_month: Column) -> Column:
    """An interval meets a fiscal year."""
    return overlaps(valid_from, valid_to, fiscal_start(year, first_month), fiscal_end(year, first_month))


def statement_due(year: Column, first_month: Column, days: int) -> Column:
    """end of the fiscal year plus days."""
    return F.date_add(fiscal_end(year, first_month), days)


def period_years(start: Column, end: Column, first_month: Column, closed_years: int = 3) -> Column:
    """years of a takeover period, plan years, and whether the start was assumed."""
    begin = F.coalesce(start, fiscal_start(fiscal_year(end, first_month) - closed_years, first_month))
    years = F.sequence(fiscal_year(begin, first_month), fiscal_year(end, first_month))
    late = F.pmod(F.month(end) - first_month, F.lit(12)) >= 9
    return F.struct(years.alias("years"), F.when(late, F.concat(years, F.array(F.element_at(years, -1) + 1))).otherwise(years).alias("plan_years"), start.isNull().alias("assumed"))


def filing_year(period_year: Column, period_from: Column, document_date: Column) -> Column:
    """the first plausible year."""
    return F.try_element_at(F.filter(F.array(period_year, F.year(period_from), F.year(document_date)), lambda y: y.between(1990, 2100)), F.lit(1))


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays after ``start`` up to ``end``, in closed form."""
    n = F.greatest(F.datediff(end, start), F.lit(0))
    first = F.weekday(start)  # Monday is 0
    whole = F.floor(n / 7)
    rest = n - whole * 7
    extra = sum(F.when((rest >= k) & (F.pmod(first + k, F.lit(7)) < 5), 1).otherwise(0) for k in range(1, 7))
    return (whole * 5 + extra).cast("long")


def percent(part: Column, total: Column) -> Column:
    """Part of a total in hundredths of a percent, half-even; null on zero."""
    return F.when(total != 0, F.bround((part * 100).cast("decimal(20,4)") / total.cast("decimal(20,0)"), 2).cast("decimal(9,2)"))


def backoff_seconds(attempt: Column, base: int = 30, most: int = 600) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.greatest(attempt, F.lit(1)) - 1)).cast("long"))
