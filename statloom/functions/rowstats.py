"""Kernels of statistics over a function's arguments. Missing arguments don't count."""

from __future__ import annotations

import math


def _have(args):
    return [a for a in args if a is not None]


def _over(f, least=1):
    def run(*args):
        x = _have(args)
        if len(x) < least:
            return None
        try:
            return f(x)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None

    return run


def _css(x):
    m = sum(x) / len(x)
    return sum((v - m) ** 2 for v in x)


def _var(x):
    return _css(x) / (len(x) - 1)


def definition5(x: list[float], p: float) -> float:
    """Percentile definition 5: the empirical distribution, averaged at its steps."""
    x = sorted(x)
    n = len(x)
    at = n * p
    j = math.floor(at + 1e-12)
    if abs(at - j) < 1e-12 and 0 < j < n:
        return (x[j - 1] + x[j]) / 2
    return x[min(max(j if abs(at - j) < 1e-12 and j >= n else j + (abs(at - j) >= 1e-12), 1), n) - 1]


def _skew(x):
    n, m = len(x), sum(x) / len(x)
    s = math.sqrt(_var(x))
    return n / ((n - 1) * (n - 2)) * sum(((v - m) / s) ** 3 for v in x)


def _kurt(x):
    n, m = len(x), sum(x) / len(x)
    s = math.sqrt(_var(x))
    return n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sum(((v - m) / s) ** 4 for v in x) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


def _geo(fuzz):
    def f(x):
        if min(x) < 0:
            return None
        if any(v == 0 or fuzz and v < 1e-12 * max(x) for v in x):
            return 0.0
        return math.exp(sum(map(math.log, x)) / len(x))

    return f


def _har(fuzz):
    def f(x):
        if min(x) < 0:
            return None
        if any(v == 0 or fuzz and v < 1e-12 * max(x) for v in x):
            return 0.0
        return len(x) / sum(1 / v for v in x)

    return f


def _mad(x):
    m = definition5(x, 0.5)
    return definition5([abs(v - m) for v in x], 0.5)


def _kth(k, args, reverse=False):
    x = sorted(_have(args), reverse=reverse)
    return x[int(k) - 1] if k is not None and 1 <= k <= len(x) else None


def ordinal(k, *args):
    """k-th smallest with missing as the least."""
    x = sorted(args, key=lambda v: (v is not None, v if v is not None else 0.0))
    return x[int(k) - 1] if k is not None and 1 <= k <= len(x) else None


def pctl(p, *args):
    x = _have(args)
    return definition5(x, p / 100) if x and p is not None and 0 <= p <= 100 else None


def lpnorm(p, *args):
    x = _have(args)
    return sum(abs(v) ** p for v in x) ** (1 / p) if x and p is not None and p >= 1 else None


KERNELS = {
    "N": (lambda *a: float(len(_have(a))), "n"),
    "NMISS": (lambda *a: float(len(a) - len(_have(a))), "n"),
    "CMISS": (lambda *a: float(sum(v is None or isinstance(v, str) and not v.strip(" ") for v in a)), "n"),
    "SUM": (_over(math.fsum), "n"),
    "MEAN": (_over(lambda x: math.fsum(x) / len(x)), "n"),
    "MIN": (_over(min), "n"),
    "MAX": (_over(max), "n"),
    "RANGE": (_over(lambda x: max(x) - min(x)), "n"),
    "CSS": (_over(_css), "n"),
    "USS": (_over(lambda x: sum(v * v for v in x)), "n"),
    "VAR": (_over(_var, 2), "n"),
    "STD": (_over(lambda x: math.sqrt(_var(x)), 2), "n"),
    "STDERR": (_over(lambda x: math.sqrt(_var(x) / len(x)), 2), "n"),
    "CV": (_over(lambda x: 100 * math.sqrt(_var(x)) / (sum(x) / len(x)), 2), "n"),
    "RMS": (_over(lambda x: math.sqrt(sum(v * v for v in x) / len(x))), "n"),
    "EUCLID": (_over(lambda x: math.sqrt(sum(v * v for v in x))), "n"),
    "SUMABS": (_over(lambda x: sum(map(abs, x))), "n"),
    "SKEWNESS": (_over(_skew, 3), "n"),
    "KURTOSIS": (_over(_kurt, 4), "n"),
    "MEDIAN": (_over(lambda x: definition5(x, 0.5)), "n"),
    "IQR": (_over(lambda x: definition5(x, 0.75) - definition5(x, 0.25)), "n"),
    "MAD": (_over(_mad), "n"),
    "GEOMEAN": (_over(_geo(True)), "n"),
    "GEOMEANZ": (_over(_geo(False)), "n"),
    "HARMEAN": (_over(_har(True)), "n"),
    "HARMEANZ": (_over(_har(False)), "n"),
    "LARGEST": (lambda k, *a: _kth(k, a, True), "n"),
    "SMALLEST": (lambda k, *a: _kth(k, a), "n"),
    "ORDINAL": (ordinal, "n"),
    "PCTL": (pctl, "n"),
    "LPNORM": (lpnorm, "n"),
}
