"""Exact and stratified inference on small tables: kernels on counts that an aggregate made."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np

from statloom.functions import special as sp
from statloom.functions.catalog import call
from statloom.functions.distributions import chi_cdf
from statloom.operators.tables import chi_tests

MOST_TABLES = 3_000_000


def _log_fact(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def fixed_margins(rows: np.ndarray, cols: np.ndarray):
    """(table, probability) of every table with these margins, under independence."""
    rows, cols = [int(x) for x in rows], [int(x) for x in cols]
    lf = _log_fact(sum(rows))
    const = lf[rows].sum() + lf[cols].sum() - lf[sum(rows)]
    seen = 0

    def column(total: int, room: list[int]):
        """Ways to deal a column's total over the rows' room."""
        if len(room) == 1:
            if total <= room[0]:
                yield (total,)
            return
        for first in range(max(0, total - sum(room[1:])), min(total, room[0]) + 1):
            for rest in column(total - first, room[1:]):
                yield (first, *rest)

    def walk(k: int, room: list[int], done: list):
        nonlocal seen
        if k == len(cols) - 1:
            t = np.array([*done, room]).T
            seen += 1
            if seen > MOST_TABLES:
                raise ValueError(f"more than {MOST_TABLES} tables; take the Monte Carlo estimate")
            yield t, math.exp(const - lf[t].sum())
            return
        for c in column(cols[k], room):
            yield from walk(k + 1, [r - x for r, x in zip(room, c)], [*done, list(c)])

    yield from walk(0, rows, [])


STATISTICS: dict[str, Callable[[np.ndarray], float]] = {
    "pearson": lambda t: chi_tests(t.astype(float))["Chi-Square"][0],
    "lr": lambda t: chi_tests(t.astype(float))["Likelihood Ratio Chi-Square"][0],
    "mh": lambda t: chi_tests(t.astype(float)).get("Mantel-Haenszel Chi-Square", (0.0,))[0],
}


def exact_p(t: np.ndarray, statistic: str = "fisher") -> float:
    """The chance of a table as extreme: for "fisher" (Freeman-Halton) of one no likelier,
    else of one whose statistic is no smaller."""
    t = t.astype(int)
    tables = fixed_margins(t.sum(1), t.sum(0))
    if statistic == "fisher":
        both = [(p, np.array_equal(x, t)) for x, p in tables]
        own = next(p for p, same in both if same)
        return float(min(1.0, sum(p for p, _ in both if p <= own * (1 + 1e-7))))
    f = STATISTICS[statistic]
    own = f(t)
    return float(min(1.0, sum(p for x, p in tables if f(x) >= own * (1 - 1e-9))))


def monte_carlo_p(t: np.ndarray, statistic: str = "pearson", n: int = 10_000, seed: int = 1, alpha: float = 0.01) -> tuple[float, float, float]:
    """(estimate, lower, upper) of the exact p from tables of permuted pairs."""
    t = t.astype(int)
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(t.shape[0]), t.sum(1))
    b = np.repeat(np.arange(t.shape[1]), t.sum(0))
    f = STATISTICS[statistic]
    own, hits = f(t), 0
    for _ in range(n):
        x = np.zeros_like(t)
        np.add.at(x, (a, rng.permutation(b)), 1)
        hits += f(x) >= own * (1 - 1e-9)
    p = hits / n
    half = sp.norm_quantile(1 - alpha / 2) * math.sqrt(p * (1 - p) / (n - 1))
    return p, max(0.0, p - half), min(1.0, p + half)


def odds_ratio_limits(t: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Exact conditional limits of a 2x2 table's odds ratio."""
    (a, b), (c, d) = t.astype(int)
    r, k, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r + k - n), min(r, k)
    xs = np.arange(lo, hi + 1)
    lc = lambda m, x: math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1)
    base = np.array([lc(k, x) + lc(n - k, r - x) for x in xs])

    def tail(log_odds: float, upper: bool) -> float:
        w = base + xs * log_odds
        w = np.exp(w - w.max())
        w /= w.sum()
        return float(w[xs >= a].sum() if upper else w[xs <= a].sum())

    low = 0.0 if a == lo else math.exp(sp.solve(lambda v: tail(v, True), -60, 60, alpha / 2))
    high = math.inf if a == hi else math.exp(sp.solve(lambda v: tail(v, False), -60, 60, alpha / 2, rising=False))
    return low, high


def zelen(strata: list[np.ndarray]) -> float:
    """Zelen's exact test of equal odds ratios in 2x2 strata: given the sum of the first
    cells, the chance of strata as unlikely."""
    dists = []
    for t in strata:
        (a, b), (c, d) = t.astype(int)
        n, r, k = a + b + c + d, a + b, a + c
        lc = lambda m, x: math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1)
        dists.append((a, {x: math.exp(lc(k, x) + lc(n - k, r - x) - lc(n, r)) for x in range(max(0, r + k - n), min(r, k) + 1)}))
    total = sum(a for a, _ in dists)
    own = math.prod(d[a] for a, d in dists)
    every = hits = 0.0
    for xs in itertools.product(*[d for _, d in dists[:-1]]):
        last = total - sum(xs)
        if last in dists[-1][1]:
            p = math.prod(d[x] for x, (_, d) in zip(xs, dists)) * dists[-1][1][last]
            every += p
            hits += p if p <= own * (1 + 1e-7) else 0.0
    return hits / every


def common_odds_exact(strata: list[np.ndarray], alpha: float = 0.05) -> tuple[float, float, float]:
    """(p of a common odds ratio of 1, lower, upper): the strata's distributions convolved."""
    poly, low, own = np.ones(1), 0, 0
    for t in strata:
        (a, b), (c, d) = t.astype(int)
        n, r, k = a + b + c + d, a + b, a + c
        lo, hi = max(0, r + k - n), min(r, k)
        lc = lambda m, x: math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1)
        w = np.array([lc(k, x) + lc(n - k, r - x) - lc(n, r) for x in range(lo, hi + 1)])
        poly, low, own = np.convolve(poly, np.exp(w)), low + lo, own + a
    xs = np.arange(low, low + len(poly))
    with np.errstate(divide="ignore"):
        base = np.log(poly)

    def dist(v):
        w = base + xs * v
        w = np.exp(w - w.max())
        return w / w.sum()

    p0 = dist(0.0)
    here = p0[own - low]
    two = float(p0[p0 <= here * (1 + 1e-7)].sum())
    lower = 0.0 if own == low else math.exp(sp.solve(lambda v: float(dist(v)[xs >= own].sum()), -60, 60, alpha / 2))
    upper = math.inf if own == xs[-1] else math.exp(sp.solve(lambda v: float(dist(v)[xs <= own].sum()), -60, 60, alpha / 2, rising=False))
    return two, lower, upper


def blaker_limits(x: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Blaker's exact limits of a proportion."""

    def accept(p: float) -> float:
        pm = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)])
        up, down = pm[::-1].cumsum()[::-1], pm.cumsum()
        if up[x] < down[x]:
            other = down[down <= up[x] * (1 + 1e-9)]
            return up[x] + (other.max() if len(other) else 0.0)
        other = up[up <= down[x] * (1 + 1e-9)]
        return down[x] + (other.max() if len(other) else 0.0)

    cp_lo = 0.0 if x == 0 else call("BETAINV", alpha / 2, float(x), float(n - x + 1))
    cp_hi = 1.0 if x == n else call("BETAINV", 1 - alpha / 2, float(x + 1), float(n - x))
    grid = np.linspace(cp_lo, cp_hi, 2001)[1:-1]
    ok = [p for p in grid if accept(p) >= alpha]
    return (0.0 if x == 0 else float(min(ok))), (1.0 if x == n else float(max(ok)))


def risk_difference_limits(t: np.ndarray, alpha: float = 0.05) -> dict[str, tuple[float, float]]:
    """Wald (with and without correction), Newcombe, Agresti-Caffo and score limits."""
    (a, b), (c, d) = t.astype(float)
    n1, n2 = a + b, c + d
    p1, p2 = a / n1, c / n2
    z = sp.norm_quantile(1 - alpha / 2)
    diff, se = p1 - p2, math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    cc = (1 / n1 + 1 / n2) / 2

    def wilson(x, n):
        mid, half = (x + z * z / 2) / (n + z * z), z * math.sqrt(n) / (n + z * z) * math.sqrt(x / n * (1 - x / n) + z * z / (4 * n))
        return mid - half, mid + half

    (l1, u1), (l2, u2) = wilson(a, n1), wilson(c, n2)
    q1, q2 = (a + 1) / (n1 + 2), (c + 1) / (n2 + 2)
    ac = z * math.sqrt(q1 * (1 - q1) / (n1 + 2) + q2 * (1 - q2) / (n2 + 2))
    score = lambda delta: _score_z(a, n1, c, n2, delta)
    low = -1.0 if score(-1 + 1e-9) < z else sp.solve(score, -1 + 1e-9, diff, z, rising=False)
    high = 1.0 if score(1 - 1e-9) > -z else sp.solve(score, diff, 1 - 1e-9, -z, rising=False)
    return {
        "wald": (diff - z * se, diff + z * se),
        "wald_cc": (diff - z * se - cc, diff + z * se + cc),
        "newcombe": (diff - math.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), diff + math.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)),
        "agresti_caffo": (q1 - q2 - ac, q1 - q2 + ac),
        "score": (low, high),
    }


def constrained_rates(a: float, n1: float, c: float, n2: float, delta: float) -> tuple[float, float]:
    """Maximum-likelihood rates with difference delta (Farrington and Manning's cubic)."""
    th = n2 / n1
    p1, p2 = a / n1, c / n2
    k3, k2 = 1 + th, -(1 + th + p1 + th * p2 + delta * (th + 2))
    k1, k0 = delta**2 + delta * (2 * p1 + th + 1) + p1 + th * p2, -p1 * delta * (1 + delta)
    v = k2**3 / (27 * k3**3) - k2 * k1 / (6 * k3**2) + k0 / (2 * k3)
    u = math.copysign(math.sqrt(max(k2**2 / (9 * k3**2) - k1 / (3 * k3), 0.0)), v)
    w = (math.pi + math.acos(max(-1.0, min(1.0, v / u**3)) if u else 0.0)) / 3
    x = min(max(2 * u * math.cos(w) - k2 / (3 * k3), max(0.0, delta)), min(1.0, 1 + delta))
    return x, x - delta


def _score_z(a, n1, c, n2, delta):
    r1, r2 = constrained_rates(a, n1, c, n2, delta)
    v = (r1 * (1 - r1) / n1 + r2 * (1 - r2) / n2) * (n1 + n2) / (n1 + n2 - 1)
    return (a / n1 - c / n2 - delta) / math.sqrt(max(v, 1e-300))


def noninferiority(t: np.ndarray, margin: float, lower: bool = True) -> tuple[float, float]:
    """(z, p) of the risk difference against -margin (or below +margin), by the
    constrained rates."""
    (a, b), (c, d) = t.astype(float)
    z = _score_z(a, a + b, c, c + d, -margin if lower else margin)
    return z, sp.norm_cdf(-z) if lower else sp.norm_cdf(z)


def barnard(t: np.ndarray, points: int = 400) -> float:
    """Barnard's unconditional test: two-sided, ordered by the pooled z, the greatest
    chance over the common rate."""
    (a, b), (c, d) = t.astype(int)
    n1, n2 = a + b, c + d
    x, y = np.meshgrid(np.arange(n1 + 1), np.arange(n2 + 1), indexing="ij")
    pool = (x + y) / (n1 + n2)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.nan_to_num((x / n1 - y / n2) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)))
    extreme = np.abs(z) >= abs(z[a, c]) - 1e-9
    l1 = np.array([math.lgamma(n1 + 1) - math.lgamma(k + 1) - math.lgamma(n1 - k + 1) for k in range(n1 + 1)])
    l2 = np.array([math.lgamma(n2 + 1) - math.lgamma(k + 1) - math.lgamma(n2 - k + 1) for k in range(n2 + 1)])
    best = 0.0
    for p in np.linspace(0, 1, points + 2)[1:-1]:
        m = np.exp((l1[:, None] + l2[None, :]) + (x + y) * math.log(p) + (n1 + n2 - x - y) * math.log1p(-p))
        best = max(best, float(m[extreme].sum()))
    return min(1.0, best)


def mantel_haenszel(strata: list[np.ndarray], alpha: float = 0.05) -> dict[str, tuple[float, float, float]]:
    """Common odds ratio, relative risk and risk difference: (estimate, lower, upper), with
    the Robins-Breslow-Greenland, Greenland-Robins and Sato variances; and the logit
    estimate of the odds ratio."""
    z = sp.norm_quantile(1 - alpha / 2)
    r = s = pr = ps_qr = qs = 0.0
    rn = rd = rv = 0.0
    dn = dw = dp = dq = 0.0
    lw = lws = 0.0
    for t in strata:
        (a, b), (c, d) = t.astype(float)
        n, n1, n2 = t.sum(), a + b, c + d
        p, q, ri, si = (a + d) / n, (b + c) / n, a * d / n, b * c / n
        r, s = r + ri, s + si
        pr, ps_qr, qs = pr + p * ri, ps_qr + p * si + q * ri, qs + q * si
        rn, rd = rn + a * n2 / n, rd + c * n1 / n
        rv += (n1 * n2 * (a + c) - a * c * n) / n**2
        dn, dw = dn + (a * n2 - c * n1) / n, dw + n1 * n2 / n
        dp += (n1**2 * c - n2**2 * a + n1 * n2 * (n2 - n1) / 2) / n**2
        dq += (a * (n2 - c) + c * (n1 - a)) / (2 * n)
        if min(a, b, c, d) > 0:
            w = 1 / (1 / a + 1 / b + 1 / c + 1 / d)
            lw, lws = lw + w, lws + w * math.log(a * d / (b * c))
    out = {}
    v = pr / (2 * r * r) + ps_qr / (2 * r * s) + qs / (2 * s * s)
    out["Odds Ratio (Mantel-Haenszel)"] = (r / s, r / s * math.exp(-z * math.sqrt(v)), r / s * math.exp(z * math.sqrt(v)))
    if lw:
        m = lws / lw
        out["Odds Ratio (Logit)"] = (math.exp(m), math.exp(m - z / math.sqrt(lw)), math.exp(m + z / math.sqrt(lw)))
    v = rv / (rn * rd)
    out["Relative Risk (Mantel-Haenszel)"] = (rn / rd, rn / rd * math.exp(-z * math.sqrt(v)), rn / rd * math.exp(z * math.sqrt(v)))
    diff = dn / dw
    v = (diff * dp + dq) / dw**2
    out["Risk Difference (Mantel-Haenszel)"] = (diff, diff - z * math.sqrt(v), diff + z * math.sqrt(v))
    return out


def gail_simon(diffs, errors) -> tuple[float, float, float, float]:
    """(Q+, Q-, Q, p) of a qualitative interaction over strata."""
    d, e = np.asarray(diffs, float), np.asarray(errors, float)
    plus, minus = float(((d / e) ** 2)[d < 0].sum()), float(((d / e) ** 2)[d > 0].sum())
    q, k = min(plus, minus), len(d)
    p = sum(math.comb(k - 1, j) * 0.5 ** (k - 1) * (1 - chi_cdf(q, j)) for j in range(1, k))
    return plus, minus, q, p


def multinomial_p(counts: np.ndarray, expected: np.ndarray | None = None) -> float:
    """Exact chi-square goodness of fit: every way to deal n over the levels."""
    counts = counts.astype(int)
    n, k = int(counts.sum()), len(counts)
    p = np.full(k, 1 / k) if expected is None else expected / expected.sum()
    if math.comb(n + k - 1, k - 1) > MOST_TABLES:
        raise ValueError(f"more than {MOST_TABLES} outcomes; take the Monte Carlo estimate")
    e = n * p
    stat = lambda x: float(((np.array(x) - e) ** 2 / e).sum())
    own, total = stat(counts), 0.0
    lf = _log_fact(n)
    for bars in itertools.combinations(range(n + k - 1), k - 1):
        x = np.diff((-1, *bars, n + k - 1)) - 1
        if stat(x) >= own * (1 - 1e-9):
            total += math.exp(lf[n] - lf[x].sum() + float((x * np.log(p)).sum()))
    return min(1.0, total)


def hoeffding_d(x: np.ndarray, y: np.ndarray) -> float:
    """Hoeffding's D, times 30 as is usual. Quadratic in the number of values."""
    n = len(x)
    r = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    s = np.array([(y < v).sum() + ((y == v).sum() + 1) / 2 for v in y])
    q = np.empty(n)
    for i in range(n):
        lx, ly, ex, ey = x < x[i], y < y[i], x == x[i], y == y[i]
        q[i] = 1 + (lx & ly).sum() + ((ex & ey).sum() - 1) / 4 + ((ex & ly).sum() + (lx & ey).sum()) / 2
    d1 = ((q - 1) * (q - 2)).sum()
    d2 = ((r - 1) * (r - 2) * (s - 1) * (s - 2)).sum()
    d3 = ((r - 2) * (s - 2) * (q - 1)).sum()
    return float(30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4)))


def polychoric(t: np.ndarray) -> float:
    """The polychoric correlation: thresholds from the margins, then the rho of greatest
    likelihood."""
    n = t.sum()
    cut = lambda m: [-9.0, *[sp.norm_quantile(min(max(v, 1e-12), 1 - 1e-12)) for v in np.cumsum(m)[:-1] / n], 9.0]
    a, b = cut(t.sum(1)), cut(t.sum(0))

    def loglik(rho: float) -> float:
        f = np.array([[call("PROBBNRM", x, y, rho) for y in b] for x in a])
        cells = f[1:, 1:] - f[:-1, 1:] - f[1:, :-1] + f[:-1, :-1]
        return float((t * np.log(np.maximum(cells, 1e-300))).sum())

    lo, hi = -0.999, 0.999
    g = (math.sqrt(5) - 1) / 2
    x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
    f1, f2 = loglik(x1), loglik(x2)
    while hi - lo > 1e-7:
        if f1 < f2:
            lo, x1, f1 = x1, x2, f2
            x2 = lo + g * (hi - lo)
            f2 = loglik(x2)
        else:
            hi, x2, f2 = x2, x1, f1
            x1 = hi - g * (hi - lo)
            f1 = loglik(x1)
    return (lo + hi) / 2
