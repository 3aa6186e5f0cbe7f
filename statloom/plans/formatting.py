"""Formats as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom import formats
from statloom.functions.catalog import by_kernel


def format_column(x: Column, fmt: formats.UserFormat) -> Column:
    """A VALUE format as a chain of conditions; what no range holds is written as it is."""
    if fmt.picture:
        return by_kernel("picture", x, kernel=lambda v: formats.picture(fmt, v, 0), kind="c")
    out: Column = F.lit(fmt.other) if fmt.other is not None else x.cast("string")
    char = fmt.name.startswith("$")
    for lo, hi, lx, hx, label in reversed(fmt.ranges):
        v = F.rtrim(x) if char else x
        conds = [v.isNotNull()]
        if lo is not None:
            conds.append(v > F.lit(lo) if lx else v >= F.lit(lo))
        if hi is not None:
            conds.append(v < F.lit(hi) if hx else v <= F.lit(hi))
        out = F.when(reduce(lambda a, b: a & b, conds), F.lit(label)).otherwise(out)
    return out


def put_column(x: Column, spec: str, kind: str = "n", catalog: formats.Catalog | None = None) -> Column:
    """PUT(x, format.): native for the common ones, else by the kernel."""
    name, w, d = formats.split_spec(spec)
    if catalog and name in catalog and not w:
        return format_column(x, catalog[name])
    day = F.date_add(F.lit("1960-01-01").cast("date"), F.floor(x).cast("int"))
    missing = lambda made, width: F.when(x.isNull(), F.lpad(F.lit("."), width, " ")).otherwise(made)
    if name == "DATE" and w == 9:
        return missing(F.upper(F.date_format(day, "ddMMMyyyy")), 9)
    if name == "YYMMDD" and w == 10 or name == "E8601DA" and w in (0, 10):
        return missing(F.date_format(day, "yyyy-MM-dd"), 10)
    if name == "MMDDYY" and w == 10:
        return missing(F.date_format(day, "MM/dd/yyyy"), 10)
    if name == "$" and w:
        return F.rpad(F.substring(F.coalesce(x, F.lit("")), 1, w), w, " ")
    return by_kernel("put", x, kernel=lambda v: formats.put(v if v is not None or kind == "n" else "", spec, catalog), kind="c")


def input_column(s: Column, spec: str, catalog: formats.Catalog | None = None) -> Column:
    """INPUT(s, informat.)."""
    name, w, d = formats.split_spec(spec)
    if name in ("", "F", "BEST") and not d:
        text = F.trim(F.substring(s, 1, w) if w else s)
        grammar = r"^[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$"
        return F.when(text.rlike(grammar), F.regexp_replace(text, "[Dd]", "E").try_cast("double"))
    if name == "YYMMDD" and w == 10:
        day = F.try_to_date(F.trim(s), "yyyy-MM-dd")
        return F.datediff(day, F.lit("1960-01-01").cast("date")).cast("double")
    return by_kernel("input", s, kernel=lambda v: formats.read(v, spec, catalog), kind="c" if name.startswith("$") else "n")
