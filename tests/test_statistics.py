"""Test and measure kernels against known or independently computed values."""

import itertools
import math

import numpy as np
import pytest

from statloom.operators import exact, tables, univariate

T22 = np.array([[3, 1], [1, 3]])


def test_chi_square_and_fisher():
    t = np.array([[10.0, 20.0], [30.0, 40.0]])
    c = tables.chi_tests(t)
    assert c["Chi-Square"][0] == pytest.approx(0.79365, abs=1e-5) and c["Chi-Square"][1] == 1
    f = tables.fisher_exact(T22)
    assert f["two"] == pytest.approx(0.4857142857) and f["left"] == pytest.approx(0.9857142857)
    assert exact.exact_p(T22) == pytest.approx(f["two"])


def test_exact_tables_sum_to_one():
    t = np.array([[2, 1, 0], [1, 3, 2]])
    ps = [p for _, p in exact.fixed_margins(t.sum(1), t.sum(0))]
    assert sum(ps) == pytest.approx(1)
    est, lo, hi = exact.monte_carlo_p(t, "pearson", 2000)
    assert lo - 0.02 <= exact.exact_p(t, "pearson") <= hi + 0.02 and lo <= est <= hi


def test_measures_by_pairs():
    t = np.array([[5.0, 2.0, 1.0], [2.0, 6.0, 3.0]])
    pts = [(i, j) for i in range(2) for j in range(3) for _ in range(int(t[i, j]))]
    con = dis = 0
    for (a, b), (c, d) in itertools.combinations(pts, 2):
        s = (a - c) * (b - d)
        con, dis = con + (s > 0), dis + (s < 0)
    assert tables.measures(t)["Gamma"] == pytest.approx((con - dis) / (con + dis))


def test_agreement():
    t = np.array([[20.0, 5.0], [10.0, 15.0]])
    k, _ = tables.kappa(t)
    assert k == pytest.approx(0.4)
    x, p, ex = tables.mcnemar(t)
    assert x == pytest.approx(25 / 15) and 0 < p < ex < 1


def test_stratified():
    strata = [np.array([[10, 20], [15, 25]]), np.array([[8, 12], [9, 30]])]
    mh = exact.mantel_haenszel(strata)
    num = sum(t[0, 0] * t[1, 1] / t.sum() for t in strata)
    den = sum(t[0, 1] * t[1, 0] / t.sum() for t in strata)
    assert mh["Odds Ratio (Mantel-Haenszel)"][0] == pytest.approx(num / den)
    assert all(lo < e < hi for e, lo, hi in mh.values())
    assert tables.cmh([t.astype(float) for t in strata])["Mantel-Haenszel Odds Ratio"][0] == pytest.approx(num / den)
    assert 0 < exact.zelen(strata) <= 1
    p, lo, hi = exact.common_odds_exact(strata)
    assert lo < num / den < hi and 0 < p <= 1


def test_single_stratum_exact_odds_equals_fisher():
    p, lo, hi = exact.common_odds_exact([T22])
    assert p == pytest.approx(tables.fisher_exact(T22)["two"])
    assert (lo, hi) == pytest.approx(exact.odds_ratio_limits(T22))
    weights = lambda v: [math.comb(4, x) ** 2 * v**x for x in range(5)]
    assert sum(weights(lo)[3:]) / sum(weights(lo)) == pytest.approx(0.025)
    assert sum(weights(hi)[:4]) / sum(weights(hi)) == pytest.approx(0.025)


def test_proportions():
    b = tables.binomial(8, 20)
    assert b["wilson_lower"] == pytest.approx(0.2188, abs=1e-4) and b["exact_lower"] == pytest.approx(0.1912, abs=1e-4) and b["exact_upper"] == pytest.approx(0.6395, abs=1e-4)
    lo, hi = exact.blaker_limits(8, 20)
    assert b["exact_lower"] <= lo < 0.4 < hi <= b["exact_upper"]
    d = exact.risk_difference_limits(np.array([[56, 14], [48, 32]]))
    assert d["newcombe"] == pytest.approx((0.0524, 0.3339), abs=1e-4)
    assert all(lo < 0.2 < hi for lo, hi in d.values())
    assert exact.barnard(np.array([[7, 12], [8, 3]])) == pytest.approx(0.0682, abs=2e-3)


def test_goodness_of_fit_exact():
    p = exact.multinomial_p(np.array([3, 1]))
    assert p == pytest.approx(10 / 16)


def test_ranks_and_correlations():
    x = np.arange(8.0)
    assert exact.hoeffding_d(x, x) == pytest.approx(1.0)
    assert exact.polychoric(np.array([[40, 10], [10, 40]])) == pytest.approx(math.sin(math.pi / 2 * 0.6), abs=1e-3)


def test_univariate_kernels():
    x = np.array([2.1, 3.3, 1.9, 4.8, 3.0, 2.7, 5.1, 3.9, 2.2, 3.6])
    w, p = univariate.shapiro_wilk(x)
    assert 0.9 < w < 1 and 0.05 < p < 1
    t = univariate.location_tests(x, 3.0)
    assert t["Student's t"][0] == pytest.approx((x.mean() - 3) / (x.std(ddof=1) / math.sqrt(10)))
    ranks = univariate.mean_ranks(np.abs(x[x != 3.0] - 3.0))
    assert ranks.sum() == pytest.approx(9 * 10 / 2)
    g = univariate.fit_distribution(np.random.default_rng(1).gamma(3.0, 2.0, 20000), "gamma")
    assert g["alpha"] == pytest.approx(3, rel=0.05) and g["sigma"] == pytest.approx(2, rel=0.05)
    wb = univariate.fit_distribution(np.random.default_rng(2).weibull(1.7, 20000) * 3, "weibull")
    assert wb["c"] == pytest.approx(1.7, rel=0.05) and wb["sigma"] == pytest.approx(3, rel=0.05)
    grid, dens = univariate.kernel_density(x)
    assert np.trapezoid(dens, grid) == pytest.approx(1, abs=0.01)
    e = univariate.edf_statistics(np.array([0.1, 0.4, 0.7]), lambda v: v)
    assert e["D"] == pytest.approx(0.3)
