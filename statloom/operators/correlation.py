"""PROC CORR: cross moments in one aggregate, rank measures from counts of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.catalog import by_kernel


def _p_of_r(r, n):
    from statloom.functions.distributions import t_cdf

    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return 2 * t_cdf(-abs(r) * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)


def pearson(df: DataFrame, var: list[str], weight: str | None = None) -> DataFrame:
    """(x, y, r, n, p, cov, csscp, sscp) for every pair of variables, over rows where both
    are there. One pass: a sum of products for each pair, at most var^2 aggregates."""
    aggs, pairs = [], [(a, b) for k, a in enumerate(var) for b in var[k:]]
    w = f"cast({weight} as double)" if weight else "1D"
    for k, (a, b) in enumerate(pairs):
        both = f"{a} is not null and {b} is not null" + (f" and {weight} is not null" if weight else "")
        x, y = f"cast({a} as double)", f"cast({b} as double)"
        if weight:
            aggs += [F.expr(f"sum(case when {both} then {e} end)").alias(f"{n}{k}") for n, e in (("w", w), ("x", f"{w} * {x}"), ("y", f"{w} * {y}"), ("xy", f"{w} * {x} * {y}"), ("xx", f"{w} * {x} * {x}"), ("yy", f"{w} * {y} * {y}"))]
        else:
            aggs += [F.expr(f"corr(case when {both} then {x} end, case when {both} then {y} end)").alias(f"r{k}"), F.expr(f"covar_samp(case when {both} then {x} end, case when {both} then {y} end)").alias(f"c{k}"), F.expr(f"sum(case when {both} then {x} * {y} end)").alias(f"xy{k}")]
        aggs.append(F.expr(f"count(case when {both} then 1 end)").alias(f"n{k}"))
    one = df.agg(*aggs)
    rows = []
    for k, (a, b) in enumerate(pairs):
        n = F.col(f"n{k}")
        if weight:
            sw, sx, sy, xy, xx, yy = (F.col(f"{c}{k}") for c in ("w", "x", "y", "xy", "xx", "yy"))
            cs = xy - sx * sy / sw
            r = cs / F.sqrt((xx - sx * sx / sw) * (yy - sy * sy / sw))
            cov, sscp = cs / (n - 1), xy
        else:
            r, cov, sscp = F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"xy{k}")
            cs = cov * (n - 1)
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("r"), n.alias("n"), cov.alias("cov"), cs.alias("csscp"), sscp.alias("sscp")))
    out = one.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return out.withColumn("p", by_kernel("p", F.col("r"), F.col("n").cast("double"), kernel=_p_of_r, kind="n"))


def _ranks(df: DataFrame, c: str) -> DataFrame:
    w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    k = df.groupBy(c).agg(F.count("*").alias("__k"))
    return k.select(c, (F.sum("__k").over(w) - (F.col("__k") - 1) / 2).alias(f"__r_{c}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(r, n, p): Pearson's r of the mean ranks. Rows are first counted by value pair."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("__c"))
    marg = lambda c: cells.groupBy(c).agg(F.sum("__c").alias("__k"))

    def ranks(c):
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        return marg(c).select(c, (F.sum("__k").over(w) - (F.col("__k") - 1) / 2).alias(f"__r_{c}"))

    j = cells.join(ranks(x), x).join(ranks(y), y)
    a, b, k = F.col(f"__r_{x}"), F.col(f"__r_{y}"), F.col("__c")
    s = j.agg(F.sum(k).alias("n"), F.sum(k * a).alias("sa"), F.sum(k * b).alias("sb"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"), F.sum(k * a * b).alias("ab"))
    r = (F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt((F.col("aa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("bb") - F.col("sb") * F.col("sb") / F.col("n")))
    out = s.select(r.alias("r"), "n")
    return out.withColumn("p", by_kernel("p", F.col("r"), F.col("n").cast("double"), kernel=_p_of_r, kind="n"))


def kendall(df: DataFrame, x: str, y: str, most: int = 4_000_000) -> DataFrame:
    """(tau, n): Kendall's tau-b from the counts of value pairs, a table of x by y levels
    that comes to the driver if it has at most ``most`` cells."""
    import numpy as np

    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).count()
    got = cells.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} different pairs")
    table = got.pivot(index=x, columns=y, values="count").fillna(0).to_numpy(dtype=float)
    n = table.sum()
    below = table[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    con = sum((table[:-1, :-1] * below[1:, 1:]).ravel()) if min(table.shape) > 1 else 0.0
    below_left = table[::-1].cumsum(0)[::-1].cumsum(1)
    dis = sum((table[:-1, 1:] * below_left[1:, :-1]).ravel()) if min(table.shape) > 1 else 0.0
    tx, ty = (table.sum(1) ** 2).sum(), (table.sum(0) ** 2).sum()
    den = np.sqrt((n * n - tx) * (n * n - ty))
    tau = float(2 * (con - dis) / den) if den else None
    return df.sparkSession.createDataFrame([(tau, int(n))], "tau double, n long")


def cronbach_alpha(df: DataFrame, var: list[str]) -> DataFrame:
    """(raw, standardized) coefficient alpha over complete rows."""
    full = df.dropna(subset=var)
    total = sum((F.col(v) for v in var[1:]), F.col(var[0]))
    k = len(var)
    pairs = [(a, b) for i, a in enumerate(var) for b in var[i + 1 :]]
    s = full.agg(sum((F.var_samp(v) for v in var[1:]), F.var_samp(var[0])).alias("v"), F.var_samp(total).alias("t"), (sum((F.corr(a, b) for a, b in pairs[1:]), F.corr(*pairs[0])) / len(pairs)).alias("m"))
    return s.select((k / (k - 1) * (1 - F.col("v") / F.col("t"))).alias("raw"), (k * F.col("m") / (1 + (k - 1) * F.col("m"))).alias("standardized"))


def fisher_z(r: float, n: int, alpha: float = 0.05) -> dict[str, float]:
    """Fisher's z, its bias, and the confidence limits of the correlation."""
    import math

    from statloom.functions.special import norm_quantile

    z, bias = math.atanh(r), r / (2 * (n - 1))
    half = norm_quantile(1 - alpha / 2) / math.sqrt(n - 3)
    return {"z": z, "bias": bias, "corr": math.tanh(z - bias), "lower": math.tanh(z - bias - half), "upper": math.tanh(z - bias + half)}
