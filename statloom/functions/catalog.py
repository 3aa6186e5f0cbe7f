"""All functions by name: the Python kernel, the native column, and the fallback column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom import formats
from statloom.functions import chars, dates, distributions, draws, finance, native, numeric, prx, rowstats

#: Kernels that need a catalog or session; without one they use the built-in formats.
SESSION = {
    "PUT": (lambda x, spec: formats.put(x, spec), "c"),
    "PUTN": (lambda x, spec, *a: formats.put(x, chars.text(spec)), "c"),
    "PUTC": (lambda x, spec, *a: formats.put(x, chars.text(spec)), "c"),
    "INPUT": (lambda s, spec: formats.read(s, spec), "n"),
    "INPUTN": (lambda s, spec, *a: formats.read(s, chars.text(spec)), "n"),
    "INPUTC": (lambda s, spec, *a: chars.text(formats.read(s, chars.text(spec))), "c"),
    "CONSTANT": (lambda name, *a: constant(name, *a), "n"),
    "SLEEP": (lambda *a: 0.0, "n"),
    "WTO": (lambda *a: 0.0, "n"),
    "SYSPROD": (lambda name: 1.0 if chars.text(name).strip().upper() in ("BASE", "STAT") else 0.0, "n"),
    "MODEXIST": (lambda name: 0.0, "n"),
    "TZONEID": (lambda *a: "UTC", "c"),
    "TZONENAME": (lambda *a: "UTC", "c"),
    "TZONEOFF": (lambda *a: 0.0, "n"),
    "TZONES2U": (lambda x, *a: x, "n"),
    "TZONEU2S": (lambda x, *a: x, "n"),
    "FMTINFO": (lambda name, what: fmtinfo(name, what), "c"),
    "MSPLINT": (lambda x, n, *a: msplint(x, n, *a), "n"),
}


def constant(name, *args):
    """CONSTANT(name): mathematical and machine constants."""
    import sys

    key = chars.text(name).strip().upper()
    table = {"PI": math.pi, "E": math.e, "EULER": 0.5772156649015329, "EXACTINT": 2.0 ** (8 * args[0] - 0) if args else 2.0**53, "BIG": sys.float_info.max, "SMALL": sys.float_info.min, "MACEPS": sys.float_info.epsilon, "LOGBIG": math.log(sys.float_info.max), "LOGSMALL": math.log(sys.float_info.min), "LOGMACEPS": math.log(sys.float_info.epsilon), "SQRTBIG": math.sqrt(sys.float_info.max), "SQRTSMALL": math.sqrt(sys.float_info.min), "SQRTMACEPS": math.sqrt(sys.float_info.epsilon)}
    return table.get(key)


def fmtinfo(name, what):
    n, w = chars.text(name).strip().upper(), chars.text(what).strip().upper()
    if w == "CAT":
        return "date" if n in ("DATE", "MMDDYY", "DDMMYY", "YYMMDD", "MONYY") else "datetime" if n == "DATETIME" else "time" if n == "TIME" else "char" if n.startswith("$") else "num"
    return {"TYPE": "both" if n.lstrip("$") in formats.INFORMATS else "format", "MIND": "0", "MAXD": "31", "MINW": "1", "MAXW": "32", "DEFW": "12", "DESC": n}.get(w, "")


def msplint(x, n, *a):
    """Monotone cubic (Fritsch-Carlson) through the points, whose x come first."""
    n = int(n)
    xs, ys = a[:n], a[n : 2 * n]
    if x is None or any(v is None for v in (*xs, *ys)):
        return None
    h = [xs[k + 1] - xs[k] for k in range(n - 1)]
    d = [(ys[k + 1] - ys[k]) / h[k] for k in range(n - 1)]
    m = [d[0], *((0.0 if d[k - 1] * d[k] <= 0 else 3 * (h[k - 1] + h[k]) / ((2 * h[k] + h[k - 1]) / d[k - 1] + (h[k] + 2 * h[k - 1]) / d[k])) for k in range(1, n - 1)), d[-1]]
    k = min(max(sum(v <= x for v in xs) - 1, 0), n - 2)
    t = (x - xs[k]) / h[k]
    return ys[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[k] * t * (1 - t) ** 2 + ys[k + 1] * t * t * (3 - 2 * t) - h[k] * m[k + 1] * t * t * (1 - t)


KERNELS: dict[str, tuple] = {}
for part in (numeric, rowstats, distributions, chars, dates, finance, prx, draws):
    KERNELS |= part.KERNELS
KERNELS |= SESSION


def names() -> list[str]:
    return sorted(KERNELS)


def result_kind(name: str) -> str:
    return KERNELS[name.upper()][1]


def call(name: str, *args):
    """The kernel's value for Python arguments."""
    key = name.upper()
    if key not in KERNELS:
        raise formats.UnsupportedFeature(f"function {name}")
    return KERNELS[key][0](*args)


def _clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def by_kernel(name: str, *cols: Column, kernel=None, kind: str | None = None) -> Column:
    """The kernel over Arrow batches, for what Spark has no expression."""
    f, k = KERNELS[name.upper()] if kernel is None else (kernel, kind)

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*[_clean(v) for v in row]) for row in zip(*series)], dtype=object)

    def nothing(series: pd.Series) -> pd.Series:
        return pd.Series([f()] * len(series), dtype=object)

    udf = F.pandas_udf(run if cols else nothing, "string" if k == "c" else "double")
    return udf(*cols) if cols else udf(F.lit(0))


def column(name: str, *cols: Column, kinds: str = "") -> Column:
    """The function as a column: native where Spark can say it, else by the kernel."""
    key = name.upper()
    if key == "MISSING":
        c = cols[0]
        return (F.when(F.rtrim(F.coalesce(c, F.lit(""))) == "", 1.0).otherwise(0.0) if kinds[:1] == "c" else c.isNull().cast("double"))
    if key == "CMISS":
        each = [F.rtrim(F.coalesce(c, F.lit(""))) == "" if k == "c" else c.isNull() for c, k in zip(cols, kinds)]
        return sum((e.cast("double") for e in each), F.lit(0.0))
    if key in native.BUILDERS and not ("c" in kinds and key in ("MIN", "MAX")):
        try:
            out = native.BUILDERS[key](*cols)
        except TypeError:
            out = None
        if out is not None:
            return out
    if key not in KERNELS:
        raise formats.UnsupportedFeature(f"function {name}")
    return by_kernel(key, *cols)
