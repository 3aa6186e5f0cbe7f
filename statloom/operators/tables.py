"""Tests and measures of FREQ tables: counts on the cluster, kernels on the table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from statloom.functions import special as sp
from statloom.functions.distributions import chi_cdf
from statloom.operators.summary import freq

MOST_CELLS = 250_000


def table_of(df: DataFrame, row: str, col: str, weight: str | None = None) -> tuple[np.ndarray, list, list]:
    """The counts as an array, with its levels in order. Levels are few: the number of
    cells is checked before they come to the driver."""
    cells = freq(df, [row, col], weight).select(row, col, "COUNT").limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    rows, cols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    out = np.zeros((len(rows), len(cols)))
    at, bt = {v: k for k, v in enumerate(rows)}, {v: k for k, v in enumerate(cols)}
    for a, b, n in cells:
        out[at[a], bt[b]] = n
    return out, rows, cols


def chi_tests(t: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """Name: (value, df, p). Pearson, likelihood ratio, continuity-adjusted (2x2),
    Mantel-Haenszel; phi, contingency coefficient and Cramer's V without p."""
    n, r, c = t.sum(), t.sum(1), t.sum(0)
    e = np.outer(r, c) / n
    df = (len(r) - 1) * (len(c) - 1)
    x2 = float(((t - e) ** 2 / e).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = float(2 * np.where(t > 0, t * np.log(t / e), 0).sum())
    out = {"Chi-Square": (x2, df, 1 - chi_cdf(x2, df)), "Likelihood Ratio Chi-Square": (g2, df, 1 - chi_cdf(g2, df))}
    if t.shape == (2, 2):
        adj = float((np.maximum(0, np.abs(t - e) - 0.5) ** 2 / e).sum())
        out["Continuity Adj. Chi-Square"] = (adj, 1, 1 - chi_cdf(adj, 1))
    a, b = np.arange(1, len(r) + 1), np.arange(1, len(c) + 1)
    rho = _score_corr(t, a, b)
    if rho is not None:
        mh = (n - 1) * rho * rho
        out["Mantel-Haenszel Chi-Square"] = (float(mh), 1, 1 - chi_cdf(mh, 1))
    phi = math.sqrt(x2 / n)
    if t.shape == (2, 2):
        det = t[0, 0] * t[1, 1] - t[0, 1] * t[1, 0]
        phi = math.copysign(phi, det)
    k = min(len(r), len(c)) - 1
    out["Phi Coefficient"] = (phi, math.nan, math.nan)
    out["Contingency Coefficient"] = (math.sqrt(x2 / (x2 + n)), math.nan, math.nan)
    out["Cramer's V"] = (phi if t.shape == (2, 2) else math.sqrt(x2 / n / k) if k else math.nan, math.nan, math.nan)
    return out


def _score_corr(t, a, b):
    n = t.sum()
    ma, mb = (t.sum(1) @ a) / n, (t.sum(0) @ b) / n
    va, vb = t.sum(1) @ (a - ma) ** 2, t.sum(0) @ (b - mb) ** 2
    return float((a - ma) @ t @ (b - mb) / math.sqrt(va * vb)) if va > 0 and vb > 0 else None


def fisher_exact(t: np.ndarray) -> dict[str, float]:
    """2x2: left, right, two-sided and table probability."""
    (a, b), (c, d) = t.astype(int)
    n, r, k = a + b + c + d, a + b, a + c
    lc = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    p = {x: math.exp(lc(k, x) + lc(n - k, r - x) - lc(n, r)) for x in range(max(0, r + k - n), min(r, k) + 1)}
    return {"left": sum(v for x, v in p.items() if x <= a), "right": sum(v for x, v in p.items() if x >= a), "two": sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)), "table": p[a]}


def measures(t: np.ndarray) -> dict[str, float]:
    """Gamma, Kendall's tau-b, Stuart's tau-c, Somers' D, Pearson, Spearman, lambda and
    uncertainty coefficients."""
    n, r, c = t.sum(), t.sum(1), t.sum(0)
    ge = t[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    gl = t[::-1].cumsum(0)[::-1].cumsum(1)
    p = 2 * float((t[:-1, :-1] * ge[1:, 1:]).sum())
    q = 2 * float((t[:-1, 1:] * gl[1:, :-1]).sum())
    wr, wc = n * n - (r**2).sum(), n * n - (c**2).sum()
    m = min(t.shape)
    a, b = np.arange(1, len(r) + 1), np.arange(1, len(c) + 1)
    ra, rb = np.cumsum(r) - (r - 1) / 2, np.cumsum(c) - (c - 1) / 2
    h = lambda x: float(-(x[x > 0] / n * np.log(x[x > 0] / n)).sum())
    hr, hc, hrc = h(r), h(c), h(t.ravel())
    top_r, top_c = float(t.max(1).sum()), float(t.max(0).sum())
    lcr, lrc = (top_r - c.max()) / (n - c.max()) if n > c.max() else math.nan, (top_c - r.max()) / (n - r.max()) if n > r.max() else math.nan
    return {
        "Gamma": (p - q) / (p + q) if p + q else math.nan, "Kendall's Tau-b": (p - q) / math.sqrt(wr * wc) if wr * wc else math.nan, "Stuart's Tau-c": m * (p - q) / (n * n * (m - 1)) if m > 1 else math.nan,
        "Somers' D C|R": (p - q) / wr if wr else math.nan, "Somers' D R|C": (p - q) / wc if wc else math.nan, "Pearson Correlation": _score_corr(t, a, b) or math.nan, "Spearman Correlation": _score_corr(t, ra, rb) or math.nan,
        "Lambda Asymmetric C|R": lcr, "Lambda Asymmetric R|C": lrc, "Lambda Symmetric": (top_r + top_c - c.max() - r.max()) / (2 * n - c.max() - r.max()),
        "Uncertainty Coefficient C|R": (hr + hc - hrc) / hc if hc else math.nan, "Uncertainty Coefficient R|C": (hr + hc - hrc) / hr if hr else math.nan, "Uncertainty Coefficient Symmetric": 2 * (hr + hc - hrc) / (hr + hc) if hr + hc else math.nan,
    }


def association(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """(statistic, value, df, p): the chi-square tests, measures and, of a 2x2 table,
    Fisher's exact test, odds ratio and relative risks."""
    t, _, _ = table_of(df, row, col, weight)
    rows = [(k, *v) for k, v in chi_tests(t).items()] + [(k, v, math.nan, math.nan) for k, v in measures(t).items()]
    if t.shape == (2, 2):
        rows += [(f"Fisher {k}", v, math.nan, v) for k, v in fisher_exact(t).items()]
        rows += [(k, v, math.nan, math.nan) for k, v in risks(t).items()]
    clean = [(k, *[None if isinstance(x, float) and math.isnan(x) else float(x) for x in v]) for k, *v in rows]
    return df.sparkSession.createDataFrame(clean, "statistic string, value double, df double, p double")


def risks(t: np.ndarray, alpha: float = 0.05) -> dict[str, float]:
    """Odds ratio and relative risks with logit limits; risk difference with Wald limits."""
    (a, b), (c, d) = t
    z = sp.norm_quantile(1 - alpha / 2)
    out = {}
    if min(a, b, c, d) > 0:
        orr, se = a * d / (b * c), math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        out |= {"Odds Ratio": orr, "Odds Ratio Lower": orr * math.exp(-z * se), "Odds Ratio Upper": orr * math.exp(z * se)}
    p1, p2, n1, n2 = a / (a + b), c / (c + d), a + b, c + d
    if a and c:
        rr, se = p1 / p2, math.sqrt((1 - p1) / a + (1 - p2) / c)
        out |= {"Relative Risk (Column 1)": rr, "Relative Risk (Column 1) Lower": rr * math.exp(-z * se), "Relative Risk (Column 1) Upper": rr * math.exp(z * se)}
    se = math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return out | {"Risk Difference": p1 - p2, "Risk Difference Lower": p1 - p2 - z * se, "Risk Difference Upper": p1 - p2 + z * se}


def mcnemar(t: np.ndarray) -> tuple[float, float, float]:
    b, c = t[0, 1], t[1, 0]
    x = (b - c) ** 2 / (b + c)
    n, k = int(b + c), int(min(b, c))
    exact = min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n)
    return float(x), 1 - chi_cdf(x, 1), exact


def kappa(t: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Cohen's kappa (weighted with Cicchetti-Allison weights or those given) and its
    asymptotic standard error."""
    n, k = t.sum(), len(t)
    p = t / n
    w = np.eye(k) if weights is None else weights
    r, c = p.sum(1), p.sum(0)
    po, pe = (w * p).sum(), (w * np.outer(r, c)).sum()
    kap = (po - pe) / (1 - pe)
    wr, wc = w @ c, w.T @ r
    inner = (p * (w - (wr[:, None] + wc[None, :]) * (1 - kap)) ** 2).sum() - (kap - pe * (1 - kap)) ** 2
    return float(kap), float(math.sqrt(max(inner, 0) / n) / (1 - pe))


def linear_weights(k: int) -> np.ndarray:
    i = np.arange(k)
    return 1 - np.abs(i[:, None] - i[None, :]) / (k - 1)


def bowker(t: np.ndarray) -> tuple[float, float, float]:
    x = df = 0.0
    for i in range(len(t)):
        for j in range(i):
            if (s := t[i, j] + t[j, i]) > 0:
                x += (t[i, j] - t[j, i]) ** 2 / s
                df += 1
    return float(x), df, 1 - chi_cdf(x, df) if df else math.nan


def trend(t: np.ndarray) -> tuple[float, float]:
    """Cochran-Armitage: (Z, two-sided p) of a table with two columns or two rows."""
    if t.shape[1] != 2:
        t = t.T
    s = np.arange(1, len(t) + 1)
    n, r = t.sum(), t.sum(1)
    p = t[:, 0].sum() / n
    m = (r @ s) / n
    num = (t[:, 0] * (s - m)).sum()
    z = num / math.sqrt(p * (1 - p) * (r @ (s - m) ** 2))
    return float(z), 2 * sp.norm_cdf(-abs(z))


def jonckheere(t: np.ndarray) -> tuple[float, float, float]:
    """(JT, Z, two-sided p): rows are ordered groups, columns ordered responses."""
    jt = 0.0
    for i in range(len(t)):
        for k in range(i + 1, len(t)):
            before = np.concatenate(([0], np.cumsum(t[i])[:-1]))
            jt += float((t[k] * (before + t[i] / 2)).sum())
    n, r, c = t.sum(), t.sum(1), t.sum(0)
    mean = (n * n - (r**2).sum()) / 4
    a = n * (n - 1) * (2 * n + 5) - (r * (r - 1) * (2 * r + 5)).sum() - (c * (c - 1) * (2 * c + 5)).sum()
    b = (r * (r - 1) * (r - 2)).sum() * (c * (c - 1) * (c - 2)).sum()
    d = (r * (r - 1)).sum() * (c * (c - 1)).sum()
    var = a / 72 + b / (36 * n * (n - 1) * (n - 2)) + d / (8 * n * (n - 1))
    z = (jt - mean) / math.sqrt(var)
    return jt, z, 2 * sp.norm_cdf(-abs(z))


def cmh(strata: list[np.ndarray]) -> dict[str, tuple[float, float, float]]:
    """Cochran-Mantel-Haenszel: correlation, row mean scores, general association, and
    for 2x2 strata the common odds ratio (Mantel-Haenszel) and Breslow-Day."""
    rr, cc = strata[0].shape
    a, b = np.arange(1, rr + 1), np.arange(1, cc + 1)
    out = {}
    for name, ra, cb in (("Nonzero Correlation", a[None, :], b[None, :]), ("Row Mean Scores Differ", np.eye(rr)[:-1], b[None, :]), ("General Association", np.eye(rr)[:-1], np.eye(cc)[:-1])):
        k = len(ra) * len(cb)
        g, v = np.zeros(k), np.zeros((k, k))
        bmat = np.kron(ra, cb)
        for t in strata:
            n = t.sum()
            if n < 2:
                continue
            r, c = t.sum(1) / n, t.sum(0) / n
            g += bmat @ (t.ravel() - n * np.kron(r, c))
            v += bmat @ (n * n / (n - 1) * np.kron(np.diag(r) - np.outer(r, r), np.diag(c) - np.outer(c, c))) @ bmat.T
        q = float(g @ np.linalg.pinv(v) @ g)
        out[name] = (q, k, 1 - chi_cdf(q, k))
    if (rr, cc) == (2, 2):
        num = sum(t[0, 0] * t[1, 1] / t.sum() for t in strata)
        den = sum(t[0, 1] * t[1, 0] / t.sum() for t in strata)
        orr = num / den
        out["Mantel-Haenszel Odds Ratio"] = (orr, math.nan, math.nan)
        bd = 0.0
        for t in strata:
            r, c, n = t[0].sum(), t[:, 0].sum(), t.sum()
            q2, q1, q0 = 1 - orr, n - r - c + orr * (r + c), -orr * r * c
            root = math.sqrt(q1 * q1 - 4 * q2 * q0)
            x = next((x for x in ((-q1 + root) / (2 * q2), (-q1 - root) / (2 * q2)) if max(0, r + c - n) <= x <= min(r, c)), r * c / n) if abs(q2) > 1e-12 else r * c / n
            var = 1 / (1 / x + 1 / (r - x) + 1 / (c - x) + 1 / (n - r - c + x))
            bd += (t[0, 0] - x) ** 2 / var
        out["Breslow-Day"] = (bd, len(strata) - 1, 1 - chi_cdf(bd, len(strata) - 1) if len(strata) > 1 else math.nan)
    return out


def cochran_q(t: np.ndarray) -> tuple[float, float, float]:
    """Cochran's Q of a subjects-by-treatments array of 0 and 1."""
    k = t.shape[1]
    c, r = t.sum(0), t.sum(1)
    q = (k - 1) * (k * (c**2).sum() - c.sum() ** 2) / (k * r.sum() - (r**2).sum())
    return float(q), k - 1, 1 - chi_cdf(q, k - 1)


def goodness_of_fit(counts: np.ndarray, expected: np.ndarray | None = None) -> tuple[float, float, float]:
    """One-way chi-square against given proportions, equal ones by default."""
    n = counts.sum()
    e = np.full(len(counts), n / len(counts)) if expected is None else expected / expected.sum() * n
    x = float(((counts - e) ** 2 / e).sum())
    return x, len(counts) - 1, 1 - chi_cdf(x, len(counts) - 1)


def binomial(x: int, n: int, p0: float = 0.5, alpha: float = 0.05) -> dict[str, float]:
    """Proportion, ASE, Wald, Wilson, Agresti-Coull, Jeffreys and exact limits; tests of p0."""
    from statloom.functions.catalog import call

    p, z = x / n, sp.norm_quantile(1 - alpha / 2)
    ase = math.sqrt(p * (1 - p) / n)
    mid, half = (x + z * z / 2) / (n + z * z), z * math.sqrt(n) / (n + z * z) * math.sqrt(p * (1 - p) + z * z / (4 * n))
    nt = n + z * z
    ac = z * math.sqrt(mid * (1 - mid) / nt)
    q = lambda pr, a, b: call("BETAINV", pr, a, b)
    zt = (p - p0) / math.sqrt(p0 * (1 - p0) / n)
    pm = [math.comb(n, k) * p0**k * (1 - p0) ** (n - k) for k in range(n + 1)]
    lo, hi = sum(pm[: x + 1]), sum(pm[x:])
    return {
        "proportion": p, "ase": ase, "wald_lower": p - z * ase, "wald_upper": p + z * ase, "wilson_lower": mid - half, "wilson_upper": mid + half, "ac_lower": mid - ac, "ac_upper": mid + ac,
        "jeffreys_lower": q(alpha / 2, x + 0.5, n - x + 0.5), "jeffreys_upper": q(1 - alpha / 2, x + 0.5, n - x + 0.5), "exact_lower": 0.0 if x == 0 else q(alpha / 2, x, n - x + 1), "exact_upper": 1.0 if x == n else q(1 - alpha / 2, x + 1, n - x),
        "z": zt, "p_two": 2 * sp.norm_cdf(-abs(zt)), "exact_one": min(lo, hi), "exact_two": min(1.0, 2 * min(lo, hi)),
    }
