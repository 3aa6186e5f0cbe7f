"""INTCK and INTNX as columns: native for months, weeks and days, else by the kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import dates
from statloom.functions.catalog import by_kernel

_EPOCH = "1960-01-01"


def sas_date(c: Column) -> Column:
    """Days since 1960 of a native date or timestamp."""
    return F.datediff(c.cast("date"), F.lit(_EPOCH).cast("date")).cast("double")


def sas_datetime(c: Column) -> Column:
    """Seconds since 1960 of a native timestamp."""
    return F.unix_micros(c.cast("timestamp")) / 1e6 + 315619200


def native_date(d: Column) -> Column:
    return F.date_add(F.lit(_EPOCH).cast("date"), F.floor(d).cast("int"))


def _months(d: Column) -> Column:
    x = native_date(d)
    return (F.year(x) - 1960) * 12 + F.month(x) - 1


def intck(spec: str, a: Column, b: Column, method: str = "D") -> Column:
    iv = dates.Interval(spec)
    if method.upper().startswith("D") and not iv.datetime and not iv.seconds:
        if iv.name in dates.MONTHS:
            size = dates.MONTHS[iv.name] * iv.multiple
            at = lambda d: F.floor((_months(d) - (iv.shift - 1)) / size)
            return (at(b) - at(a)).cast("double")
        if iv.name in ("DAY", "WEEK"):
            size = (7 if iv.name == "WEEK" else 1) * iv.multiple
            lead = (5 if iv.name == "WEEK" else 0) - (iv.shift - 1)
            at = lambda d: F.floor((F.floor(d) + lead) / size)
            return (at(b) - at(a)).cast("double")
    return by_kernel("INTCK", F.lit(spec), a, b, F.lit(method))


def intnx(spec: str, start: Column, n: int | Column, align: str = "B") -> Column:
    iv = dates.Interval(spec)
    n = F.lit(n) if isinstance(n, int) else n
    al = align.upper()[:1]
    if not iv.datetime and not iv.seconds and iv.name in dates.MONTHS and al in "BES":
        size = dates.MONTHS[iv.name] * iv.multiple
        base = F.lit(_EPOCH).cast("date")
        first = (F.floor((_months(start) - (iv.shift - 1)) / size) + n) * size + (iv.shift - 1)
        if al == "B":
            return sas_date(F.add_months(base, first.cast("int")))
        if al == "E":
            return sas_date(F.add_months(base, (first + size).cast("int"))) - 1
        return sas_date(F.add_months(native_date(start), (n * size).cast("int"))) if size == 1 else by_kernel("INTNX", F.lit(spec), start, n.cast("double"), F.lit(align))
    if not iv.datetime and iv.name == "DAY" and iv.multiple == 1:
        return (F.floor(start) + n).cast("double")
    return by_kernel("INTNX", F.lit(spec), start, n.cast("double"), F.lit(align))
