"""Spark columns for the functions that Spark's built-in expressions can say.

A builder takes the argument columns and their kinds ("n" double, "c" string) and gives a
column, or None where these arguments need the kernel. Missing numbers are null, missing
characters blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions.chars import CLASSES, STATES


def none() -> Column:
    return F.lit(None).cast("double")


def real(c: Column) -> Column:
    """Infinities and NaN are missing."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), none()).otherwise(c)


def s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def num(c: Column) -> Column:
    return c.cast("double")


def _near(x: Column) -> Column:
    return F.abs(x - F.rint(x)) < 1e-12


def _fuzzed(f):
    return lambda x: F.when(_near(x), F.rint(x)).otherwise(num(f(x)))


def _trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def _within(ok, f):
    return lambda x: F.when(ok(x), f(x))


def row(f):
    """A function of the array of the arguments that aren't missing."""
    return lambda *a: f(F.filter(F.array(*a), lambda v: v.isNotNull()))


def _total(arr: Column, g=lambda v: v) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + g(v))


def _mean(arr: Column) -> Column:
    return _total(arr) / F.when(F.size(arr) > 0, F.size(arr))


def _css(arr: Column) -> Column:
    m = _mean(arr)
    return F.when(F.size(arr) > 0, _total(arr, lambda v: (v - m) * (v - m)))


def _var(arr: Column) -> Column:
    return _css(arr) / F.when(F.size(arr) > 1, F.size(arr) - 1)


def pctl5(arr: Column, p: Column) -> Column:
    """Percentile definition 5 of an array without missing values; p from 0 to 1."""
    x, n = F.array_sort(arr), F.size(arr)
    at = n * p
    j = F.floor(at + 1e-12).cast("int")
    whole = F.abs(at - j) < 1e-12
    pick = lambda k: F.get(x, F.least(F.greatest(k, F.lit(1)), n) - 1)
    return F.when(n == 0, none()).when(whole & (j > 0) & (j < n), (pick(j) + pick(j + 1)) / 2).when(whole, pick(j)).otherwise(pick(j + 1))


def _first_of(cls: str, negate: bool):
    pattern = f"[{'^' * negate}{CLASSES[cls]}]"
    return lambda t, *start: None if start else num(F.regexp_instr(s(t), F.lit(pattern)))


def _mod(x: Column, y: Column) -> Column:
    r = F.when(y != 0, x % F.when(y != 0, y))
    slack = 1e-12 * F.greatest(F.lit(1.0), F.abs(x))
    return F.when((F.abs(r) < slack) | (F.abs(F.abs(r) - F.abs(y)) < slack), F.lit(0.0)).otherwise(r)


def _round(x: Column, unit: Column | None = None) -> Column:
    if unit is None:
        return F.signum(x) * F.floor(F.abs(x) + 0.5 + 1e-12 * F.greatest(F.lit(1.0), F.abs(x)))
    u = F.abs(unit)
    q = F.try_divide(F.abs(x), u)
    n = F.floor(q + 0.5 + 1e-12 * F.greatest(F.lit(1.0), q))
    inv = F.rint(F.try_divide(F.lit(1.0), u))
    exact = (u < 1) & (F.abs(F.try_divide(F.lit(1.0), u) - inv) < 1e-9 * inv)
    return F.when(u == 0, F.lit(0.0)).otherwise(F.signum(x) * F.when(exact, F.try_divide(n, inv)).otherwise(n * u))


def _days(d: Column) -> Column:
    return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(d).cast("int"))


def _from_date(d: Column) -> Column:
    return num(F.datediff(d, F.lit("1960-01-01").cast("date")))


def _mdy(m: Column, d: Column, y: Column) -> Column:
    year = F.when((y >= 0) & (y < 100), F.when(y + 1900 >= 1926, y + 1900).otherwise(y + 2000)).otherwise(y)
    stamp = F.concat_ws("-", F.lpad(year.cast("int").cast("string"), 4, "0"), F.lpad(m.cast("int").cast("string"), 2, "0"), F.lpad(d.cast("int").cast("string"), 2, "0"))
    return F.when(m.isNotNull() & d.isNotNull() & y.isNotNull(), _from_date(F.try_to_date(stamp, "yyyy-MM-dd")))


def _bits(f):
    def run(a, b):
        x, y = a.cast("long"), b.cast("long")
        ok = (x >= 0) & (y >= 0) & (x <= 0xFFFFFFFF) & (y <= 0xFFFFFFFF)
        return F.when(ok, num(f(x, y).bitwiseAND(F.lit(0xFFFFFFFF))))

    return run


def _least(name):
    def run(*a):
        return F.least(*a) if name == "MIN" and len(a) > 1 else F.greatest(*a) if len(a) > 1 else a[0]

    return run


def _state_map(pick):
    rows = [x.split(" ", 2) for x in STATES.split(",")]
    entries = []
    for p, n, name in rows:
        k, v = pick(p, float(n), name)
        entries += [F.lit(k), F.lit(v)]
    return F.create_map(*entries)


def _join(d: Column, items) -> Column:
    have = F.filter(F.array(*[F.btrim(s(i), F.lit(" ")) for i in items]), lambda v: v != "")
    sep = F.btrim(s(d), F.lit(" "))
    sep = F.when(sep == "", F.substring(s(d), 1, 1)).otherwise(sep)
    return F.aggregate(have, F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), lambda a, v: F.struct(F.concat(a["t"], F.when(a["k"] > 0, sep).otherwise(F.lit("")), v).alias("t"), (a["k"] + 1).alias("k")))["t"]


def rtrim(c: Column) -> Column:
    return F.rtrim(s(c))


def strip(c: Column) -> Column:
    return F.btrim(s(c), F.lit(" "))


BUILDERS = {
    "ABS": F.abs, "SIGN": F.signum, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "SINH": lambda x: real(F.sinh(x)), "COSH": lambda x: real(F.cosh(x)), "TANH": F.tanh, "ATAN": F.atan,
    "ARSIN": _within(lambda x: F.abs(x) <= 1, F.asin), "ARCOS": _within(lambda x: F.abs(x) <= 1, F.acos), "ARSINH": F.asinh, "ARCOSH": _within(lambda x: x >= 1, F.acosh), "ARTANH": _within(lambda x: F.abs(x) < 1, F.atanh),
    "COT": lambda x: real(F.cot(x)), "CSC": lambda x: real(F.csc(x)), "SEC": lambda x: real(F.sec(x)), "EXP": lambda x: real(F.exp(x)), "LOG": _within(lambda x: x > 0, F.ln), "LOG2": _within(lambda x: x > 0, F.log2), "LOG10": _within(lambda x: x > 0, F.log10),
    "LOG1PX": _within(lambda x: x > -1, F.log1p), "SQRT": _within(lambda x: x >= 0, F.sqrt), "ATAN2": lambda y, x: F.when((x != 0) | (y != 0), F.atan2(y, x)), "LOGISTIC": lambda x: 1 / (1 + F.exp(-x)),
    "CEIL": _fuzzed(F.ceil), "FLOOR": _fuzzed(F.floor), "INT": _fuzzed(_trunc), "FUZZ": _fuzzed(lambda x: x), "CEILZ": lambda x: num(F.ceil(x)), "FLOORZ": lambda x: num(F.floor(x)), "INTZ": _trunc,
    "ROUND": _round, "MOD": _mod, "MODZ": lambda x, y: F.when(y != 0, x % F.when(y != 0, y)), "DIVIDE": lambda x, y: real(F.try_divide(x, y)),
    "BAND": _bits(lambda a, b: a.bitwiseAND(b)), "BOR": _bits(lambda a, b: a.bitwiseOR(b)), "BXOR": _bits(lambda a, b: a.bitwiseXOR(b)), "BNOT": lambda a: num(F.bitwise_not(a.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))),
    "N": lambda *a: num(F.size(F.filter(F.array(*a), lambda v: v.isNotNull()))), "NMISS": lambda *a: num(F.size(F.filter(F.array(*a), lambda v: v.isNull()))),
    "SUM": row(lambda x: F.when(F.size(x) > 0, _total(x))), "MEAN": row(_mean), "MIN": _least("MIN"), "MAX": _least("MAX"), "RANGE": row(lambda x: F.array_max(x) - F.array_min(x)),
    "CSS": row(_css), "USS": row(lambda x: F.when(F.size(x) > 0, _total(x, lambda v: v * v))), "VAR": row(_var), "STD": row(lambda x: F.sqrt(_var(x))), "STDERR": row(lambda x: F.sqrt(_var(x) / F.size(x))),
    "CV": row(lambda x: F.try_divide(100 * F.sqrt(_var(x)), _mean(x))), "RMS": row(lambda x: F.sqrt(F.try_divide(_total(x, lambda v: v * v), F.size(x)))), "EUCLID": row(lambda x: F.when(F.size(x) > 0, F.sqrt(_total(x, lambda v: v * v)))), "SUMABS": row(lambda x: F.when(F.size(x) > 0, _total(x, F.abs))),
    "MEDIAN": row(lambda x: pctl5(x, F.lit(0.5))), "IQR": row(lambda x: pctl5(x, F.lit(0.75)) - pctl5(x, F.lit(0.25))), "PCTL": lambda p, *a: pctl5(F.filter(F.array(*a), lambda v: v.isNotNull()), p / 100),
    "LARGEST": lambda k, *a: F.get(F.sort_array(F.filter(F.array(*a), lambda v: v.isNotNull()), asc=False), k.cast("int") - 1), "SMALLEST": lambda k, *a: F.get(F.sort_array(F.filter(F.array(*a), lambda v: v.isNotNull())), k.cast("int") - 1), "ORDINAL": lambda k, *a: F.get(F.sort_array(F.array(*a)), k.cast("int") - 1),
    "COALESCE": F.coalesce, "COALESCEC": lambda *a: s(F.coalesce(*[F.when(F.trim(c) != "", c) for c in a])),
    "YEAR": lambda d: num(F.year(_days(d))), "MONTH": lambda d: num(F.month(_days(d))), "DAY": lambda d: num(F.dayofmonth(_days(d))), "QTR": lambda d: num(F.quarter(_days(d))), "WEEKDAY": lambda d: num(F.dayofweek(_days(d))),
    "MDY": _mdy, "YYQ": lambda y, q: F.when((q >= 1) & (q <= 4), _mdy(3 * q - 2, F.lit(1), y)), "DATEPART": lambda x: num(F.floor(x / 86400)), "TIMEPART": lambda x: x - 86400 * F.floor(x / 86400), "HOUR": lambda x: num(F.floor(x / 3600) % 24 + F.when(F.floor(x / 3600) % 24 < 0, 24).otherwise(0)), "MINUTE": lambda x: num(F.pmod(F.floor(x / 60), F.lit(60))), "SECOND": lambda x: x - 60 * F.floor(x / 60),
    "HMS": lambda h, m, sec: h * 3600 + m * 60 + sec, "DHMS": lambda d, h, m, sec: d * 86400 + h * 3600 + m * 60 + sec, "JULDATE7": lambda d: num(F.year(_days(d)) * 1000 + F.dayofyear(_days(d))), "DATE": lambda: _from_date(F.current_date()), "TODAY": lambda: _from_date(F.current_date()),
    "UPCASE": lambda c: F.upper(s(c)), "LOWCASE": lambda c: F.lower(s(c)), "TRIM": lambda c: F.when(rtrim(c) == "", F.lit(" ")).otherwise(rtrim(c)), "TRIMN": rtrim, "STRIP": strip, "KSTRIP": strip, "LEFT": lambda c: F.ltrim(s(c)), "REVERSE": lambda c: F.reverse(s(c)),
    "LENGTH": lambda c: num(F.greatest(F.length(rtrim(c)), F.lit(1))), "LENGTHN": lambda c: num(F.length(rtrim(c))), "CATS": lambda *a: F.concat(*map(strip, a)), "CATT": lambda *a: F.concat(*map(rtrim, a)), "CAT": lambda *a: F.concat(*map(s, a)), "CATX": _join,
    "COMPBL": lambda c: F.regexp_replace(s(c), " {2,}", " "), "INDEX": lambda t, sub: F.when(F.length(s(sub)) > 0, num(F.position(s(sub), s(t)))).otherwise(F.lit(0.0)), "FIND": lambda t, sub, *r: None if r else F.when(F.length(s(sub)) > 0, num(F.position(s(sub), s(t)))).otherwise(F.lit(0.0)),
    "COMPRESS": lambda c, *r: None if r else F.replace(s(c), F.lit(" "), F.lit("")), "REPEAT": lambda c, n: F.when(n >= 0, F.repeat(s(c), n.cast("int") + 1)).otherwise(F.lit("")), "FIRST": lambda c: F.substring(s(c), 1, 1), "CHAR": lambda c, n: F.when(n > 0, F.substring(s(c), n.cast("int"), F.lit(1))).otherwise(F.lit("")),
    "SUBSTRN": lambda c, p, n=None: None if n is None else F.substring(s(c), F.greatest(p.cast("int"), F.lit(1)), F.greatest(n.cast("int") - F.greatest(1 - p.cast("int"), F.lit(0)), F.lit(0))),
    "SUBSTR": lambda c, p, n=None: F.when((p >= 1) & (p <= F.greatest(F.length(s(c)), F.lit(1))), F.substring(s(c), p.cast("int"), F.lit(2**31 - 1) if n is None else n.cast("int"))).otherwise(F.lit("")),
    "TRANSTRN": lambda c, a, b: F.when(F.length(s(a)) > 0, F.replace(s(c), s(a), s(b))).otherwise(s(c)), "SHA256HEX": lambda c: F.upper(F.sha2(s(c), 256)), "COMPLEV": lambda a, b, *r: None if r else num(F.levenshtein(rtrim(a), rtrim(b))),
    "BYTE": lambda n: F.when((n >= 0) & (n < 128), F.char(n.cast("int"))).otherwise(F.lit("")), "WHICHN": lambda x, *a: F.coalesce(num(F.array_position(F.array(*a), x)), F.lit(0.0)), "STFIPS": lambda c: F.try_element_at(_state_map(lambda p, n, name: (p, n)), F.upper(strip(c))), "STNAMEL": lambda c: s(F.try_element_at(_state_map(lambda p, n, name: (p, name)), F.upper(strip(c)))), "FIPSTATE": lambda n: s(F.try_element_at(_state_map(lambda p, k, name: (k, p)), F.floor(n).cast("double"))),
}
BUILDERS |= {f"ANY{c}": _first_of(c, False) for c in CLASSES} | {f"NOT{c}": _first_of(c, True) for c in CLASSES}
CHARACTER_RESULT = {"UPCASE", "LOWCASE", "TRIM", "TRIMN", "STRIP", "KSTRIP", "LEFT", "REVERSE", "CATS", "CATT", "CAT", "CATX", "COMPBL", "COMPRESS", "REPEAT", "FIRST", "CHAR", "SUBSTRN", "SUBSTR", "TRANSTRN", "SHA256HEX", "BYTE", "STNAMEL", "FIPSTATE", "COALESCEC"}
