"""Reshaping, ranking, standardising, comparing and describing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.order import key_order


def transpose_long(df: DataFrame, by: list[str], var: list[str], name: str = "_NAME_", value: str = "COL1") -> DataFrame:
    """PROC TRANSPOSE of one row per BY group: a row per variable."""
    return df.unpivot(by, var, name, value)


def transpose_wide(df: DataFrame, by: list[str], id_var: str, var: list[str], order: list[str], levels: list | None = None, prefix: str = "", suffix: str = "", let: bool = False) -> DataFrame:
    """PROC TRANSPOSE with ID: a row per BY group and variable, a column per ID level, in
    order of first appearance. A level twice in a group is an error, unless ``let`` takes
    the last. Numeric levels become _1, _2, ... under an empty prefix."""
    if levels is None:
        first = df.groupBy(id_var).agg(F.min(F.struct(*order)).alias("o")).where(F.col(id_var).isNotNull())
        levels = [r[0] for r in first.orderBy("o").select(id_var).limit(10_001).collect()]
        if len(levels) > 10_000:
            raise ValueError("more than 10000 ID levels would be as many columns")
    names = {v: f"{prefix}{_level(v, bool(prefix))}{suffix}" for v in levels}
    out = []
    for v in var:
        # One pass of conditional aggregates: levels are few, and known.
        picks = []
        for lv, nm in names.items():
            hit = F.col(id_var) == F.lit(lv)
            value = F.max_by(F.col(v), F.when(hit, F.struct(*order)))
            once = F.count(F.when(hit, 1))
            picks.append((value if let else F.when(once <= 1, value).otherwise(F.raise_error(F.lit(f"ID value {lv} occurs twice in a BY group")))).alias(nm))
        out.append(df.groupBy(*by).agg(*picks).withColumn("_NAME_", F.lit(v)))
    return reduce(DataFrame.unionByName, out).select(*by, "_NAME_", *names.values())


def _level(v, prefixed: bool) -> str:
    s = f"{v:g}" if isinstance(v, float) else str(v)
    s = "".join(c if c.isalnum() or c == "_" else "_" for c in s.strip())
    return "_" + s if s[:1].isdigit() and not prefixed else s


def rank(df: DataFrame, var: str, out: str, by: list[str] = (), ties: str = "mean", descending: bool = False, groups: int | None = None) -> DataFrame:
    """PROC RANK: missing stays missing and isn't counted. ``groups`` k gives
    floor(rank * k / (n + 1)).

    Ranks come from the counts of the distinct values, so equal values need not meet in
    one task; a BY group's values are ordered in one."""
    by = list(by)
    known = df.where(F.col(var).isNotNull()).groupBy(*by, var).agg(F.count("*").alias("__c"))
    turn = F.col(var).desc() if descending else F.col(var).asc()
    w = Window.partitionBy(*by).orderBy(turn)
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = {"mean": upto - (F.col("__c") - 1) / 2, "low": upto - F.col("__c") + 1, "high": upto, "dense": F.row_number().over(w)}[ties].cast("double")
    n = F.sum("__c").over(Window.partitionBy(*by))
    made = F.floor(r * groups / (n + 1)).cast("double") if groups else r
    ranks = known.select(*by, var, made.alias(out))
    return _join_null_safe(df, ranks, by, var, out).select(*[c for c in df.columns if c != out], out)


def _join_null_safe(df, ranks, by, var, out):
    right = ranks.select(*[F.col(c).alias(f"__{c}") for c in (*by, var)], out)
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(var) == F.col(f"__{var}")])
    return df.join(right, cond, "left").drop(*[f"__{c}" for c in (*by, var)])


def standardise(df: DataFrame, var: list[str], by: list[str] = (), mean: float | None = None, std: float | None = None, replace: bool = False) -> DataFrame:
    """PROC STANDARD: values to the given mean and standard deviation; REPLACE fills
    missing ones with the mean. Statistics are aggregated first and joined, so the whole
    table (no BY) isn't one window partition."""
    by = list(by)
    stats = df.groupBy(*by).agg(*[f(v).alias(f"__{k}_{v}") for v in var for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    if by:
        right = stats.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[c for c in stats.columns if c not in by])
        j = df.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by])).drop(*[f"__k_{c}" for c in by])
    else:
        j = df.crossJoin(F.broadcast(stats))  # one row
    for v in var:
        m, s = F.col(f"__m_{v}"), F.col(f"__s_{v}")
        x = F.col(v)
        if std is not None:
            x = F.try_divide((F.col(v) - m) * F.lit(float(std)), s) + (F.lit(float(mean)) if mean is not None else m)
        elif mean is not None:
            x = F.col(v) - m + F.lit(float(mean))
        if replace:
            x = F.coalesce(x, F.lit(float(mean)) if mean is not None else m)
        j = j.withColumn(v, x)
    return j.drop(*[f"__{k}_{v}" for v in var for k in "ms"])


def compare(base: DataFrame, comp: DataFrame, id_vars: list[str], var: list[str], with_: list[str] | None = None, criterion: float = 1e-8, method: str = "relative") -> DataFrame:
    """PROC COMPARE OUT=: rows with a difference, by id: _TYPE_ is DIF for matched rows,
    BASE or COMPARE for those of one side; per variable base_, comp_ and dif_."""
    with_ = with_ or var
    b = base.select(*id_vars, *[F.col(v).alias(f"base_{v}") for v in var], F.lit(True).alias("__b"))
    c = comp.select(*[F.col(i).alias(f"__{i}") for i in id_vars], *[F.col(w).alias(f"comp_{v}") for v, w in zip(var, with_)], F.lit(True).alias("__c"))
    j = b.join(c, reduce(lambda x, y: x & y, [F.col(i).eqNullSafe(F.col(f"__{i}")) for i in id_vars]), "full")
    kinds = dict(base.dtypes)
    unequal: Column = F.lit(False)
    difs = []
    for v in var:
        x, y = F.col(f"base_{v}"), F.col(f"comp_{v}")
        if kinds[v] == "string":
            same = F.rtrim(F.coalesce(x, F.lit(""))) == F.rtrim(F.coalesce(y, F.lit("")))
            difs.append(F.when(same, 0.0).otherwise(1.0).alias(f"dif_{v}"))
        else:
            gap = {"relative": F.abs(y - x) / F.greatest((F.abs(x) + F.abs(y)) / 2, F.lit(1e-300)), "absolute": F.abs(y - x), "percent": 100 * F.abs(F.try_divide(y - x, x)), "exact": F.when(x == y, 0.0).otherwise(float("inf"))}[method]
            same = x.eqNullSafe(y) | F.coalesce(gap <= criterion, F.lit(False))
            difs.append((y - x).alias(f"dif_{v}"))
        unequal = unequal | ~same
    one_sided = F.col("__b").isNull() | F.col("__c").isNull()
    kind = F.when(F.col("__c").isNull(), "BASE").when(F.col("__b").isNull(), "COMPARE").otherwise("DIF")
    ids = [F.coalesce(F.col(i), F.col(f"__{i}")).alias(i) for i in id_vars]
    return j.where(one_sided | unequal).select(kind.alias("_TYPE_"), *ids, *[F.col(f"{p}_{v}") for v in var for p in ("base", "comp")], *difs)


def contents(df: DataFrame, member: str = "") -> list[dict]:
    """PROC CONTENTS: name, type, length, position, format, informat and label."""
    rows = []
    for k, f in enumerate(df.schema, 1):
        meta = f.metadata or {}
        char = isinstance(f.dataType, T.StringType)
        rows.append({"MEMNAME": member, "NAME": f.name, "TYPE": 2 if char else 1, "LENGTH": meta.get("len", 8 if not char else 32767), "VARNUM": k, "FORMAT": meta.get("format", ""), "INFORMAT": meta.get("informat", ""), "LABEL": meta.get("label", "")})
    return rows


def set_operation(kind: str, a: DataFrame, b: DataFrame, all_: bool = False, corr: bool = False) -> DataFrame:
    """UNION, EXCEPT, INTERSECT and OUTER UNION with ALL and CORR.

    CORR matches by name: on common columns only, but all columns under OUTER UNION.
    Without it columns match by position, and OUTER UNION keeps the sides apart."""
    if kind == "outer union":
        if corr:
            return a.unionByName(b, allowMissingColumns=True)
        taken = {c.lower() for c in a.columns}
        right = b.select(*[F.col(c).alias(c if c.lower() not in taken else f"{c}_2") for c in b.columns])
        return a.unionByName(right, allowMissingColumns=True)
    if corr:
        other = {c.lower(): c for c in b.columns}
        common = [c for c in a.columns if c.lower() in other]
        a, b = a.select(*common), b.select(*[F.col(other[c.lower()]).alias(c) for c in common])
    if kind == "union":
        return a.union(b) if all_ else a.union(b).distinct()
    if kind == "except":
        return a.exceptAll(b) if all_ else a.subtract(b)
    if kind == "intersect":
        return a.intersectAll(b) if all_ else a.intersect(b)
    raise ValueError(kind)


def quantified(df: DataFrame, value: str, op: str, other: DataFrame, column: str, which: str) -> DataFrame:
    """Rows where value op ANY/ALL (other.column): by the other side's least and greatest.
    Over no rows ANY is false and ALL true. Missing is the least value."""
    ends = other.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.count("*").alias("__n"), F.count_if(F.col(column).isNull()).alias("__m"), F.count_distinct(column).alias("__d"))
    j = df.crossJoin(F.broadcast(ends))  # one row
    x = F.col(value)
    # With a missing one among them, the least is missing.
    lo = F.when(F.col("__m") > 0, F.lit(None)).otherwise(F.col("__lo"))
    less = lambda a, b: F.coalesce(a < b, a.isNull() & b.isNotNull())
    edge = {("<", "any"): F.col("__hi"), ("<", "all"): lo, (">", "any"): lo, (">", "all"): F.col("__hi")}[(op[0], which)]
    strict = less(x, edge) if op[0] == "<" else less(edge, x)
    holds = strict | x.eqNullSafe(edge) if op.endswith("=") else strict
    empty = F.col("__n") == 0
    keep = F.when(empty, F.lit(which == "all")).otherwise(holds)
    return j.where(keep).drop("__lo", "__hi", "__n", "__m", "__d")


def sorted_by(df: DataFrame, by: list[str]) -> DataFrame:
    return df.orderBy(*key_order(by))
