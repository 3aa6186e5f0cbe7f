"""Special functions in plain Python: incomplete gamma and beta, inverses, Bessel, Airy."""

from __future__ import annotations

import math

EPS = 3e-16
TINY = 1e-300


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(100_000):
            k += 1
            term *= x / k
            total += term
            if abs(term) < abs(total) * EPS:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1.0 - gamma_q(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - gamma_p(a, x)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        step = d * c
        h *= step
        if abs(step - 1) < EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + num / c
            c = c if abs(c) > TINY else TINY
            h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return h


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_quantile(p: float) -> float:
    """Inverse normal: a rational start (Acklam's published coefficients), then Newton."""
    # Fixed values.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
    poly = lambda cs, x: _horner(cs, x)
    if p < 0.02425 or p > 1 - 0.02425:
        q = math.sqrt(-2 * math.log(min(p, 1 - p)))
        x = poly(c, q) / poly((*d, 1.0), q)
        x = x if p < 0.5 else -x
    else:
        q = p - 0.5
        r = q * q
        x = q * poly(a, r) / poly((*b, 1.0), r)
    for _ in range(3):
        # On the smaller tail, so that no digits cancel.
        e = norm_cdf(x) - p if x <= 0 else (1 - p) - norm_cdf(-x)
        u = e * math.sqrt(2 * math.pi) * math.exp(min(700.0, x * x / 2))
        x -= u / (1 + x * u / 2)
    return x


def _horner(cs, x):
    out = 0.0
    for k in cs:
        out = out * x + k
    return out


def solve(f, lo: float, hi: float, target: float = 0.0, rising: bool = True) -> float:
    """The x in [lo, hi] where a monotone f meets the target, by bisection."""
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if mid in (lo, hi):
            break
        if (f(mid) < target) == rising:
            lo = mid
        else:
            hi = mid
    return lo + (hi - lo) / 2


def quantile_of(cdf, p: float, lo: float, hi: float, start: float = 1.0) -> float:
    """Inverse of a continuous cdf on (lo, hi), either of which may be infinite."""
    if lo == -math.inf:
        lo = -start
        while cdf(lo) > p:
            lo *= 2
    if hi == math.inf:
        hi = max(start, lo + start)
        while cdf(hi) < p:
            hi = hi * 2 if hi > 0 else 1.0
    return solve(cdf, lo, hi, p)


def digamma(x: float) -> float:
    if x <= 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: float) -> float:
    if x <= 0:
        return -trigamma(1 - x) + (math.pi / math.sin(math.pi * x)) ** 2
    out = 0.0
    while x < 15:
        out += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def _simpson(f, a: float, b: float, n: int = 2000) -> float:
    h = (b - a) / n
    return h / 3 * (f(a) + f(b) + 4 * sum(f(a + h * k) for k in range(1, n, 2)) + 2 * sum(f(a + h * k) for k in range(2, n, 2)))


def bessel_j(nu: float, x: float) -> float:
    """J of real order: series for small x, Schlaefli's integral beyond."""
    if x == 0:
        return 1.0 if nu == 0 else 0.0
    if x < 12 or x * x < 4 * (nu + 1):
        term = math.exp(nu * math.log(x / 2) - math.lgamma(nu + 1))
        total, k = term, 0
        while abs(term) > 1e-17 * max(abs(total), 1e-300) and k < 500:
            k += 1
            term *= -(x * x / 4) / (k * (k + nu))
            total += term
        return total
    first = _simpson(lambda t: math.cos(nu * t - x * math.sin(t)), 0, math.pi) / math.pi
    if nu == int(nu):
        return first
    top = math.asinh(45 / x) + 2
    return first - math.sin(nu * math.pi) / math.pi * _simpson(lambda t: math.exp(-x * math.sinh(t) - nu * t), 0, top)


def bessel_i(nu: float, x: float, scaled: bool = False) -> float:
    if x == 0:
        return 1.0 if nu == 0 else 0.0
    shift = x if scaled else 0.0
    total, k = 0.0, 0
    while True:
        e = (2 * k + nu) * math.log(x / 2) - math.lgamma(k + 1) - math.lgamma(k + nu + 1) - shift
        term = math.exp(e) if e > -745 else 0.0
        total += term
        k += 1
        if k > x and term < total * 1e-17:
            return total


def airy(x: float, derivative: bool = False) -> float:
    """Ai or Ai': series near 0, asymptotic forms beyond."""
    if -8 < x < 6:
        c1 = 1 / (3 ** (2 / 3) * math.gamma(2 / 3))
        c2 = 1 / (3 ** (1 / 3) * math.gamma(1 / 3))
        f, g, df, dg = 1.0, x, 0.0, 1.0
        a, b = 1.0, x
        for k in range(1, 200):
            da = a * x * x / (3 * k - 1) if k else 0.0
            a *= x**3 / ((3 * k - 1) * (3 * k))
            db = b * x * x / (3 * k) if k else 0.0
            b *= x**3 / ((3 * k) * (3 * k + 1))
            f, g, df, dg = f + a, g + b, df + da, dg + db
            if abs(a) + abs(b) + abs(da) + abs(db) < 1e-18 * (abs(f) + abs(g) + 1e-300):
                break
        return c1 * df - c2 * dg if derivative else c1 * f - c2 * g
    z = 2 / 3 * abs(x) ** 1.5
    u, us = 1.0, [1.0]
    for k in range(1, 15):
        u *= (6 * k - 5) * (6 * k - 3) * (6 * k - 1) / (216 * k * (2 * k - 1))
        us.append(u)
    vs = [1.0, *(-(6 * k + 1) / (6 * k - 1) * us[k] for k in range(1, 15))]
    if x > 0:
        s = sum((-1) ** k * (vs if derivative else us)[k] / z**k for k in range(15))
        return (-(x**0.25) if derivative else 1 / x**0.25) * math.exp(-z) / (2 * math.sqrt(math.pi)) * s
    w = vs if derivative else us
    even = sum((-1) ** k * w[2 * k] / z ** (2 * k) for k in range(7))
    odd = sum((-1) ** k * w[2 * k + 1] / z ** (2 * k + 1) for k in range(7))
    at = z - math.pi / 4
    if derivative:
        return abs(x) ** 0.25 / math.sqrt(math.pi) * (math.sin(at) * even - math.cos(at) * odd)
    return (math.cos(at) * even + math.sin(at) * odd) / (math.sqrt(math.pi) * abs(x) ** 0.25)
