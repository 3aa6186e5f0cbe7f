"""Kernels against known values, and native columns against kernels."""

import math

import pytest
from pyspark.sql import functions as F

from statloom.functions import KERNELS, call, column

KNOWN = [
    ("ROUND", (2.675, 0.01), 2.68), ("ROUND", (-2.5,), -3.0), ("ROUNDE", (2.5,), 2.0), ("MOD", (10.0, 3.0), 1.0), ("MOD", (-10.0, 3.0), -1.0), ("INT", (-2.7,), -2.0), ("CEIL", (2.0000000000001,), 2.0),
    ("SUM", (1.0, None, 2.0), 3.0), ("SUM", (None, None), None), ("MEAN", (1.0, None, 2.0), 1.5), ("MEDIAN", (1.0, 2.0, 3.0, 4.0), 2.5), ("N", (1.0, None), 1.0), ("NMISS", (1.0, None), 1.0), ("STD", (1.0, 2.0, 3.0, 4.0), 1.2909944487358056),
    ("SKEWNESS", (1.0, 2.0, 3.0, 4.0, 10.0), 1.6970562748477143), ("KURTOSIS", (1.0, 2.0, 3.0, 4.0, 10.0), 3.152), ("PCTL", (25.0, *map(float, range(1, 11))), 3.0), ("LARGEST", (2.0, 5.0, 9.0, None), 5.0), ("ORDINAL", (1.0, 5.0, None), None),
    ("PROBNORM", (1.96,), 0.9750021048517795), ("PROBIT", (0.975,), 1.959963984540054), ("PROBT", (2.228138851986274, 10.0), 0.975), ("CINV", (0.95, 3.0), 7.814727903251178), ("FINV", (0.95, 2.0, 10.0), 4.102821015303716), ("TINV", (0.975, 10.0), 2.228138851986274),
    ("CDF", ("BINOMIAL", 3.0, 0.5, 10.0), 0.171875), ("PDF", ("POISSON", 2.0, 3.0), 0.22404180765538775), ("QUANTILE", ("NORMAL", 0.5), 0.0), ("CDF", ("GAMMA", 2.0, 3.0), 0.3233235838169366), ("GAMINV", (0.5, 1.0), math.log(2)), ("BETAINV", (0.5, 1.0, 1.0), 0.5),
    ("GAMMA", (5.0,), 24.0), ("COMB", (5.0, 2.0), 10.0), ("PERM", (5.0, 2.0), 20.0), ("DIGAMMA", (1.0,), -0.5772156649015329), ("TRIGAMMA", (1.0,), math.pi**2 / 6), ("AIRY", (1.0,), 0.13529241631288141), ("JBESSEL", (0.0, 1.0), 0.7651976865579666), ("IBESSEL", (0.0, 1.0, 0.0), 1.2660658777520084),
    ("GCD", (12.0, 18.0), 6.0), ("LCM", (4.0, 6.0), 12.0), ("BAND", (12.0, 10.0), 8.0), ("BNOT", (0.0,), 4294967295.0), ("PROBBNRM", (0.0, 0.0, 0.5), 1 / 3), ("FACT", (5.0,), 120.0), ("TRUNC", (0.1, 3.0), 0.0999908447265625),
    ("SCAN", ("a b,c", 2.0), "b"), ("SCAN", ("a b c", -1.0), "c"), ("SUBSTR", ("abcdef", 2.0, 3.0), "bcd"), ("CATX", ("-", "a ", "", "b"), "a-b"), ("COMPRESS", ("a b c",), "abc"), ("COMPRESS", ("a1b2", "", "kd"), "12"), ("COUNTW", ("one two  three",), 3.0), ("INDEX", ("hello", "l"), 3.0),
    ("FIND", ("Hello", "L", "i"), 3.0), ("TRANSLATE", ("abc", "x", "b"), "axc"), ("TRANWRD", ("a b a", "a", "z"), "z b z"), ("PROPCASE", ("john o'neil",), "John O'neil"), ("VERIFY", ("abc1", "abc"), 4.0), ("ANYDIGIT", ("ab3",), 3.0), ("NOTALPHA", ("ab3",), 3.0), ("SOUNDEX", ("Robert",), "R163"),
    ("COMPLEV", ("kitten", "sitting"), 3.0), ("LENGTH", ("   ",), 1.0), ("LENGTHN", ("   ",), 0.0), ("REPEAT", ("ab", 2.0), "ababab"), ("REVERSE", ("abc",), "cba"), ("QUOTE", ('a"b',), '"a""b"'), ("DEQUOTE", ("'it''s'",), "it's"), ("STFIPS", ("NC",), 37.0), ("STNAMEL", ("nc",), "North Carolina"), ("FIPSTATE", (37.0,), "NC"),
    ("MDY", (3.0, 26.0, 2020.0), 22000.0), ("YEAR", (22000.0,), 2020.0), ("WEEKDAY", (22000.0,), 5.0), ("QTR", (22000.0,), 1.0), ("JULDATE7", (22000.0,), 2020086.0), ("DATEJUL", (2020086.0,), 22000.0), ("INTCK", ("month", 0.0, 400.0), 13.0), ("INTNX", ("month", 22000.0, 1.0, "e"), 22035.0), ("INTNX", ("week", 22000.0, 0.0), 21996.0),
    ("INTCK", ("weekday", 21998.0, 22005.0), 5.0), ("INTNX", ("year", 22000.0, 1.0, "s"), 22365.0), ("HOLIDAY", ("easter", 2020.0), 22017.0), ("HOLIDAY", ("thanksgiving", 2020.0), 22245.0), ("YRDIF", (0.0, 366.0, "ACT/ACT"), 1.0), ("NWKDOM", (3.0, 2.0, 1.0, 2020.0), 21934.0), ("WEEK", (22000.0, "v"), 13.0),
    ("PRXMATCH", ("/b+/", "abbc"), 2.0), ("PRXCHANGE", ("s/(a)(b)/$2$1/", -1.0, "abab"), "baba"), ("PRXPOSN", ("/(\\d+)-(\\d+)/", 2.0, "x 12-34"), "34"), ("PMT", (0.01, 12.0, 1000.0), -88.84878867834166), ("IRR", (1.0, -100.0, 60.0, 60.0), 13.066238629180732), ("NPV", (10.0, 1.0, -100.0, 110.0), 0.0), ("DEPSL", (1.0, 100.0, 10.0), 10.0),
    ("BLKSHCLPRC", (100.0, 1.0, 100.0, 0.05, 0.2), 10.450583572185565), ("COMPOUND", (100.0, None, 0.1, 2.0), 121.0), ("EFFRATE", ("MONTH", 12.0), 12.68250301319698), ("FINANCE", ("SLN", 1000.0, 100.0, 9.0), 100.0), ("SHA256HEX", ("abc",), "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("COALESCE", (None, 3.0), 3.0), ("WHICHC", ("b", "a", "b"), 2.0), ("MISSING", (" ",), 1.0),
]


@pytest.mark.parametrize("name,args,want", KNOWN, ids=[f"{k}-{n}" for k, (n, *_) in enumerate(KNOWN)])
def test_known_values(name, args, want):
    got = call(name, *args)
    if isinstance(want, float):
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    else:
        assert got == want


def test_inverse_of_cdfs():
    for fam, params in (("NORMAL", (2.0, 3.0)), ("T", (7.0,)), ("CHISQUARE", (4.0,)), ("F", (3.0, 9.0)), ("GAMMA", (2.5,)), ("BETA", (2.0, 5.0)), ("WEIBULL", (1.5, 2.0)), ("LOGISTIC", ()), ("CAUCHY", ()), ("LAPLACE", ()), ("EXPONENTIAL", (2.0,))):
        for p in (0.01, 0.3, 0.5, 0.9, 0.999):
            assert call("CDF", fam, call("QUANTILE", fam, p, *params), *params) == pytest.approx(p, abs=1e-9), fam
    for fam, params in (("POISSON", (3.0,)), ("BINOMIAL", (0.3, 12.0)), ("GEOMETRIC", (0.2,)), ("NEGBINOMIAL", (0.4, 3.0))):
        for p in (0.05, 0.5, 0.95):
            x = call("QUANTILE", fam, p, *params)
            assert call("CDF", fam, x, *params) >= p > (call("CDF", fam, x - 1, *params) if x > 0 else -1)


def test_missing_in_missing_out():
    for name in ("ABS", "SQRT", "PROBNORM", "MDY", "YEAR"):
        assert call(name, *([None] * (3 if name == "MDY" else 1))) is None
    assert call("SQRT", -1.0) is None and call("LOG", 0.0) is None and call("DIVIDE", 1.0, 0.0) is None


NATIVE = [
    ("n", ("ROUND", "MOD", "DIVIDE", "ATAN2", "SUM", "MEAN", "MIN", "MAX", "RANGE", "N", "NMISS", "VAR", "STD", "CSS", "USS", "MEDIAN", "IQR", "EUCLID")),
    ("1", ("ABS", "SQRT", "LOG", "EXP", "INT", "CEIL", "FLOOR", "SIGN", "SIN", "YEAR", "MONTH", "DAY", "QTR", "WEEKDAY", "DATEPART", "MINUTE")),
    ("c", ("UPCASE", "LOWCASE", "TRIMN", "STRIP", "LENGTH", "LENGTHN", "REVERSE", "COMPBL", "COMPRESS", "ANYDIGIT", "NOTALPHA", "ANYSPACE", "FIRST", "LEFT", "SHA256HEX")),
]


def test_native_columns_equal_kernels(spark):
    nums = [(1.5, 2.0), (-7.25, 3.0), (None, 1.0), (0.0, 0.0), (22000.4, -2.0), (5.0, None), (100.0, 0.1)]
    df = spark.createDataFrame([(k, a, b, t) for k, ((a, b), t) in enumerate(zip(nums, ["Ab 1", "", "  x  y ", "a\tb", "ÉÉ", "123", "end "]))], "k int, a double, b double, t string")
    cols, want = [], {}
    for shape, names in NATIVE:
        for n in names:
            args = {"n": ("a", "b"), "1": ("a",), "c": ("t",)}[shape]
            cols.append(column(n, *map(F.col, args), kinds="c" if shape == "c" else "nn").alias(n))
            want[n] = args
    for r in df.select("*", *cols).collect():
        for n, args in want.items():
            got, exp = r[n], call(n, *[r[x] for x in args])
            if isinstance(exp, float):
                assert got == pytest.approx(exp, rel=1e-12, abs=1e-12), (n, r)
            else:
                assert got == exp or got in ("", None) and exp in ("", None), (n, r)


def test_kernel_columns(spark):
    r = spark.range(1).select(column("PROBNORM", F.lit(1.96)).alias("p"), column("SCAN", F.lit("a b"), F.lit(2.0)).alias("s")).first()
    assert r.p == pytest.approx(0.9750021048517795) and r.s == "b"


def test_breadth():
    assert len(KERNELS) > 350
