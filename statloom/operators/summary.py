"""Summaries: MEANS with its class combinations, FREQ tables, TABULATE and REPORT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.catalog import by_kernel
from statloom.operators.order import key_order

DEFAULT = ("n", "mean", "std", "min", "max")
PERCENTILES = {"p1": "0.01", "p5": "0.05", "p10": "0.1", "p20": "0.2", "p25": "0.25", "p30": "0.3", "p40": "0.4", "p50": "0.5", "p60": "0.6", "p70": "0.7", "p75": "0.75", "p80": "0.8", "p90": "0.9", "p95": "0.95", "p99": "0.99", "q1": "0.25", "median": "0.5", "q3": "0.75"}
_COMPLEMENT = {p: format(1 - float(p), ".2f") for p in PERCENTILES.values()}


def percentile(x: str, p: str, definition: int = 5) -> Column:
    """An exact percentile. Definition 5, the default: the average of the lower and the
    upper empirical quantile, which differ only where n*p is whole. Definition 3 is the
    lower one; 4 and 1 interpolate at (n+1)p and np; 2 takes the nearest, ties to even."""
    q = f"{float(p):.15g}"
    low = f"percentile_disc({q}BD) within group (order by {x})"
    if definition == 3:
        return F.expr(low)
    if definition == 5:
        return F.expr(f"({low} + percentile_disc({_COMPLEMENT.get(p) or 1 - float(p)}BD) within group (order by {x} desc)) / 2")
    xs = f"array_sort(collect_list({x}))"
    n = f"count({x})"
    at = {1: f"{n} * {q}D", 2: f"{n} * {q}D", 4: f"({n} + 1) * {q}D"}[definition]
    pick = lambda k: f"get({xs}, cast(greatest(1, least({k}, {n})) as int) - 1)"
    if definition == 2:
        return F.expr(pick(f"rint({at})"))
    return F.expr(f"{pick(f'floor({at})')} + ({at} - floor({at})) * ({pick(f'floor({at}) + 1')} - {pick(f'floor({at})')})")


def order_statistics(df: DataFrame, keys: list[str], x: str, wanted: dict[str, tuple[str, int]], buckets: int = 256) -> DataFrame:
    """(keys..., one column per entry of ``wanted``: name -> (p, definition 1 to 5)).

    Values are counted first. Their running counts come from buckets, by approximate
    quantiles: the counts of a group's buckets, ``buckets`` at most, are summed up by
    group, and values only within a bucket, so that no task holds a group. All
    percentiles are read off in one pass."""
    rows = df.where(F.col(x).isNotNull()).select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col(x).cast("double").alias("__v"))
    ks = [f"__k{n}" for n in range(len(keys))]
    counts = rows.groupBy(*ks, "__v").agg(F.count("*").alias("__c"))
    cuts = rows.select(F.percentile_approx("__v", [k / buckets for k in range(1, buckets)], 4096)).first()[0] or []
    at = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("__b", F.size(F.filter(at, lambda c: c < F.col("__v"))))
    whole, before = Window.partitionBy(*ks), Window.partitionBy(*ks).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*ks, "__b").agg(F.sum("__c").alias("__s"))
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("__b").alias("__b_"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__ahead"), F.sum("__s").over(whole).alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ks] + [F.col("__b") == F.col("__b_")]
    within = Window.partitionBy(*ks, "__b").orderBy("__v")
    run = counts.join(sums, same).withColumn("__to", F.sum("__c").over(within) + F.col("__ahead"))
    n, to = F.col("__n"), F.col("__to")
    nth = lambda k: F.min(F.when(to >= F.greatest(F.lit(1), F.least(k, n)), F.col("__v")))
    aggs, picks = [], []
    for j, (name, (p, definition)) in enumerate(wanted.items()):
        q = F.expr(f"{float(p):.15g}BD")
        # n * p as a decimal, so that whole products are whole.
        np_ = ((n + 1) if definition == 4 else n).cast("decimal(20,0)") * q
        low = F.floor(np_).cast("long")
        share = (np_ - low).cast("double")
        first = F.rint(np_.cast("double")).cast("long") if definition == 2 else F.ceil(np_).cast("long") if definition == 3 else low if definition in (1, 4) else F.when(share == 0, low).otherwise(low + 1)
        second = low + 1 if definition in (1, 4, 5) else first
        part = share if definition in (1, 4) else F.lit(0.5)
        aggs += [nth(first).alias(f"__a{j}"), nth(second).alias(f"__z{j}"), F.max(part).alias(f"__w{j}")]
        picks.append((F.col(f"__a{j}") + F.col(f"__w{j}") * (F.col(f"__z{j}") - F.col(f"__a{j}"))).alias(name))
    return run.groupBy(*ks).agg(*aggs).select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], *picks)


def statistic(name: str, x: str, weight: str | None = None, freq: str | None = None, vardef: str = "df", pctldef: int = 5, alpha: float = 0.05) -> Column:
    """An aggregate of column x. Rows with missing x don't count; a weight weights the
    moments; a frequency counts a row that often (truncated; under 1 not at all)."""
    has = f"{x} is not null" + (f" and {weight} is not null" if weight else "") + (f" and floor({freq}) >= 1" if freq else "")
    v = f"case when {has} then cast({x} as double) end"
    f = f"cast(floor({freq}) as double)" if freq else "1D"
    w = f"greatest({weight}, 0)" if weight else "1D"
    n, sw = f"sum(case when {has} then {f} end)", f"sum(case when {has} then {w} * {f} end)"
    s1 = f"sum({v} * {w} * {f})"
    simple = not weight and not freq
    mean = f"avg({v})" if simple else f"try_divide({s1}, {sw})"
    uss = f"sum({v} * {v} * {w} * {f})"
    css = f"(var_pop({v}) * count({v}))" if simple else f"({uss} - try_divide({s1} * {s1}, {sw}))"
    div = {"df": f"nullif({n} - 1, 0)", "n": f"{n}", "wdf": f"nullif({sw} - 1, 0)", "wgt": sw}[vardef]
    var = f"try_divide({css}, {div})"
    table = {
        "n": f"coalesce({n}, 0)",
        "nmiss": f"count_if({x} is null)" if not freq else f"coalesce(sum(case when {x} is null then floor({freq}) end), 0)",
        "mean": mean,
        "sum": s1,
        "sumwgt": sw,
        "min": f"min({v})",
        "max": f"max({v})",
        "range": f"max({v}) - min({v})",
        "uss": uss,
        "css": css,
        "var": var,
        "std": f"sqrt({var})",
        "stderr": f"sqrt({var}) / sqrt({sw if weight else n})",
        "cv": f"try_divide(100 * sqrt({var}), {mean})",
        "t": f"try_divide({mean}, sqrt({var}) / sqrt({sw if weight else n}))",
        "skewness": f"case when count({v}) > 2 then skewness({v}) * sqrt(count({v}) * (count({v}) - 1D)) / (count({v}) - 2D) end",
        "kurtosis": f"case when count({v}) > 3 then (count({v}) - 1D) / ((count({v}) - 2D) * (count({v}) - 3D)) * ((count({v}) + 1D) * kurtosis({v}) + 6) end",
    }
    key = {"avg": "mean", "stddev": "std", "skew": "skewness", "kurt": "kurtosis", "probt": "prt"}.get(name.lower(), name.lower())
    if key in PERCENTILES:
        return percentile(x, PERCENTILES[key], pctldef)
    if key == "qrange":
        return percentile(x, "0.75", pctldef) - percentile(x, "0.25", pctldef)
    if key == "mode":
        # The most frequent value, the least of ties; missing if none repeats.
        return by_kernel("mode", F.expr(f"collect_list({v})"), kernel=_mode, kind="n")
    if key in ("prt", "lclm", "uclm", "clm"):
        m, se, k = statistic("mean", x, weight, freq, vardef), statistic("stderr", x, weight, freq, vardef), statistic("n", x, weight, freq)
        if key == "prt":
            t = F.abs(statistic("t", x, weight, freq, vardef))
            return by_kernel("prt", t, k.cast("double"), kernel=_prt, kind="n")
        q = by_kernel("tq", k.cast("double"), F.lit(alpha / 2), kernel=_tq, kind="n")
        return m - q * se if key == "lclm" else m + q * se
    if key not in table:
        raise ValueError(f"statistic {name}")
    return F.expr(table[key])


def _mode(values):
    from collections import Counter

    c = Counter(values if values is not None else ())
    if not c:
        return None
    v, k = min(c.items(), key=lambda e: (-e[1], e[0]))
    return float(v) if k > 1 else None


def _prt(t, n):
    from statloom.functions.distributions import t_cdf

    return None if t is None or n is None or n < 2 else 2 * t_cdf(-t, n - 1)


def _tq(n, tail):
    from statloom.functions.catalog import call

    return call("TINV", 1 - tail, n - 1) if n is not None and n > 1 else None


def means(df: DataFrame, var: list[str], stats=DEFAULT, classes: list[str] = (), nway: bool = False, types: list[list[str]] | None = None, ways: list[int] | None = None, missing: bool = False, weight: str | None = None, freq: str | None = None, by: list[str] = (), where: str | Column | None = None, names: dict | None = None, vardef: str = "df", pctldef: int = 5, id_vars: list[str] = ()) -> DataFrame:
    """PROC MEANS / SUMMARY with OUTPUT OUT=: (by, classes, _TYPE_, _FREQ_, <var>_<stat>...).

    All class combinations by default (a cube), with _TYPE_ 0 for the whole and the last
    class as the low bit; ``nway`` keeps the full cross, ``types`` and ``ways`` choose
    (grouping sets). Rows with a missing class are left out of every combination, unless
    ``missing``. ``names`` maps (var, stat) to output names. ID variables carry the value of
    the row with the greatest one."""
    if where is not None:
        df = df.where(where)
    if not missing:
        for c in classes:
            kind = dict(df.dtypes)[c]
            df = df.where(F.col(c).isNotNull() & (F.rtrim(c) != "") if kind == "string" else F.col(c).isNotNull())
    names = names or {}
    apart: dict[str, dict[str, tuple[str, int]]] = {}
    if (nway or not classes) and not weight and not freq:
        # One grouping set: percentiles come from counted values, beside the other statistics.
        parts = {s: (PERCENTILES[s], pctldef) for s in stats if s in PERCENTILES}
        if parts and 1 <= pctldef <= 5:
            apart = {v: {names.get((v, s), f"{v}_{s}"): w for s, w in parts.items()} for v in var}
    aggs = [F.count("*").alias("_FREQ_") if not freq else F.expr(f"cast(coalesce(sum(floor({freq})), 0) as bigint)").alias("_FREQ_")]
    aggs += [F.max(i).alias(i) for i in id_vars]
    plain = [(v, s) for v in var for s in stats if s not in ("mode", "prt", "lclm", "uclm") and not (apart and s in PERCENTILES)]
    late = [(v, s) for v in var for s in stats if s in ("mode", "prt", "lclm", "uclm")]
    aggs += [statistic(s, v, weight, freq, vardef, pctldef).alias(names.get((v, s), f"{v}_{s}")) for v, s in plain]
    classes, by = list(classes), list(by)
    full = (1 << len(classes)) - 1
    # Statistics that end in a kernel are made from aggregates, after the groups are few.
    for v, s in late:
        if s == "mode":
            aggs.append(F.expr(f"collect_list({v})").alias(f"__mode_{v}"))
        else:
            aggs += [statistic("mean", v, weight, freq, vardef).alias(f"__m_{v}_{s}"), statistic("stderr", v, weight, freq, vardef).alias(f"__e_{v}_{s}"), statistic("n", v, weight, freq).cast("double").alias(f"__n_{v}_{s}")]
    if not classes:
        out = df.groupBy(*by).agg(*aggs).withColumn("_TYPE_", F.lit(0).cast("long"))
    elif nway:
        out = df.groupBy(*by, *classes).agg(*aggs).withColumn("_TYPE_", F.lit(full).cast("long"))
    else:
        sets = _sets(classes, types, ways)
        grouped = df.groupingSets([[*map(F.col, by), *map(F.col, s)] for s in sets], *map(F.col, by), *map(F.col, classes))
        bit = F.grouping_id(*map(F.col, by), *map(F.col, classes))
        out = grouped.agg(bit.alias("__g"), *aggs).withColumn("_TYPE_", F.lit(full).cast("long") - F.col("__g").bitwiseAND(F.lit(full)).cast("long")).drop("__g")
    for v, s in late:
        name = names.get((v, s), f"{v}_{s}")
        if s == "mode":
            out = out.withColumn(name, by_kernel("mode", F.col(f"__mode_{v}"), kernel=_mode, kind="n")).drop(f"__mode_{v}")
            continue
        m, e, n = (F.col(f"__{k}_{v}_{s}") for k in "men")
        q = by_kernel("tq", n, F.lit(0.025), kernel=_tq, kind="n")
        made = by_kernel("prt", F.abs(F.try_divide(m, e)), n, kernel=_prt, kind="n") if s == "prt" else m - q * e if s == "lclm" else m + q * e
        out = out.withColumn(name, made).drop(f"__m_{v}_{s}", f"__e_{v}_{s}", f"__n_{v}_{s}")
    for v, wanted in apart.items():
        keys = [*by, *classes]
        found = order_statistics(df, keys, v, wanted)
        found = found.withColumnsRenamed({k: f"__q{n}" for n, k in enumerate(keys)})
        same = [F.col(k).eqNullSafe(F.col(f"__q{n}")) for n, k in enumerate(keys)]
        out = (out.join(found, same, "left") if keys else out.crossJoin(F.broadcast(found))).drop(*[f"__q{n}" for n in range(len(keys))])  # without keys, a row each
    stat_cols = [names.get((v, s), f"{v}_{s}") for v in var for s in stats]
    return out.select(*by, *classes, "_TYPE_", "_FREQ_", *id_vars, *stat_cols)


def _sets(classes: list[str], types, ways) -> list[list[str]]:
    import itertools

    every = [list(c) for k in range(len(classes) + 1) for c in itertools.combinations(classes, k)]
    if types is None and ways is None:
        return every
    wanted = [sorted(t) for t in (types or [])]
    return [s for s in every if sorted(s) in wanted or ways is not None and len(s) in ways]


def means_long(df: DataFrame, var: list[str], **options) -> DataFrame:
    """OUTPUT OUT= without statistics: a row for each of N, MIN, MAX, MEAN, STD in _STAT_."""
    order = ("n", "min", "max", "mean", "std")
    wide = means(df, var, order, **options)
    keys = [c for c in wide.columns if not any(c == f"{v}_{s}" for v in var for s in order)]
    rows = F.array(*[F.struct(F.lit(s.upper()).alias("_STAT_"), *[F.col(f"{v}_{s}").cast("double").alias(v) for v in var]) for s in order])
    return wide.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r._STAT_", *[f"__r.{v}" for v in var])


def freq(df: DataFrame, tables: list[str], weight: str | None = None, missing: bool = False, outcum: bool = False, by: list[str] = (), zeros: bool = False) -> DataFrame:
    """PROC FREQ OUT=: the levels of one or more crossed factors with COUNT and PERCENT,
    and CUM_FREQ and CUM_PCT of a one-way table. Rows with a missing factor are left out
    of counts and percents, unless ``missing`` makes them levels. Levels whose weights
    sum to 0 are left out, unless ``zeros``."""
    by = list(by)
    kinds = dict(df.dtypes)
    if not missing:
        for t in tables:
            df = df.where(F.col(t).isNotNull() & (F.rtrim(t) != "") if kinds[t] == "string" else F.col(t).isNotNull())
    count = F.sum(weight) if weight else F.count("*").cast("double")
    out = df.groupBy(*by, *tables).agg(count.alias("COUNT"))
    if weight and not zeros:
        out = out.where("COUNT <> 0")
    whole = Window.partitionBy(*by)
    # Levels are few beside rows: the window runs over the counts.
    out = out.withColumn("PERCENT", F.try_divide(100 * F.col("COUNT"), F.sum("COUNT").over(whole)))
    if outcum:
        w = Window.partitionBy(*by).orderBy(*key_order(tables)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("CUM_FREQ", F.sum("COUNT").over(w)).withColumn("CUM_PCT", F.try_divide(100 * F.col("CUM_FREQ"), F.sum("COUNT").over(whole)))
    return out


def crosstab(df: DataFrame, row: str, col: str, weight: str | None = None, missing: bool = False) -> DataFrame:
    """A two-way table with OUTPCT: COUNT, PERCENT, PCT_ROW, PCT_COL and EXPECTED."""
    out = freq(df, [row, col], weight, missing)
    r, c = F.sum("COUNT").over(Window.partitionBy(row)), F.sum("COUNT").over(Window.partitionBy(col))
    total = F.sum("COUNT").over(Window.partitionBy())
    return out.select("*", (100 * F.col("COUNT") / r).alias("PCT_ROW"), (100 * F.col("COUNT") / c).alias("PCT_COL"), (r * c / total).alias("EXPECTED"))


def tabulate(df: DataFrame, rows: list[str], cols: list[str], var: str | None = None, stats=("n",), all_rows: bool = False, all_cols: bool = False) -> DataFrame:
    """PROC TABULATE in long form: one row per row level, column level and statistic;
    _ALL_ (null level) for totals. pctn and pctsum are of the whole table."""
    base = {"n": F.count(var) if var else F.count("*"), "pctn": F.count(var) if var else F.count("*")}
    made = {s: base[s] if s in base else F.sum(var) if s == "pctsum" else statistic(s, var) for s in stats}
    for d in (*rows, *cols):
        df = df.where(F.col(d).isNotNull())
    row_sets = [rows, []] if all_rows else [rows]
    col_sets = [cols, []] if all_cols else [cols]
    sets = [[*map(F.col, r), *map(F.col, c)] for r in row_sets for c in col_sets]
    total = {"pctn": F.count(var) if var else F.count("*"), "pctsum": F.sum(var) if var else F.count("*")}
    out = df.groupingSets(sets, *map(F.col, [*rows, *cols])).agg(*[a.cast("double").alias(s) for s, a in made.items()])
    whole = df.agg(*[total[s].cast("double").alias(f"__t_{s}") for s in stats if s in total] or [F.lit(1).alias("__t")])
    out = out.crossJoin(F.broadcast(whole))  # one row of totals
    for s in stats:
        if s in total:
            out = out.withColumn(s, F.try_divide(100 * F.col(s), F.col(f"__t_{s}")))
    return out.select(*rows, *cols, *stats)


def report(df: DataFrame, group: list[str], analysis: dict[str, str], break_after: list[str] = (), rbreak: bool = False, computed: dict[str, str] | None = None) -> DataFrame:
    """PROC REPORT with GROUP variables: a row per group; BREAK AFTER's and RBREAK's
    summary rows have _BREAK_ of the variable (or _RBREAK_) and null below it. COMPUTE
    columns are expressions over the row's columns, summary rows included."""
    aggs = [statistic(s, v).alias(v) for v, s in analysis.items()]
    levels = [group] + [group[: group.index(b) + 1] for b in break_after] + ([[]] if rbreak else [])
    seen, sets = set(), []
    for s in levels:
        if tuple(s) not in seen:
            seen.add(tuple(s))
            sets.append([F.col(c) for c in s])
    g = F.grouping_id(*map(F.col, group))
    out = df.groupingSets(sets, *map(F.col, group)).agg(g.alias("__g"), *aggs)
    labels = F.lit("")
    for k in range(len(group)):
        labels = F.when(F.col("__g") == (1 << (len(group) - 1 - k)) - 1, F.lit(group[k] if k < len(group) - 1 else "")).otherwise(labels)
    out = out.withColumn("_BREAK_", F.when(F.col("__g") == (1 << len(group)) - 1, "_RBREAK_").otherwise(labels))
    for name, e in (computed or {}).items():
        out = out.withColumn(name, F.expr(e))
    return out.drop("__g").select(*group, "_BREAK_", *analysis, *(computed or {}))


def remerge(df: DataFrame, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    """SQL's remerge: aggregates beside the detail rows of their group."""
    w = Window.partitionBy(*keys)
    return reduce(lambda d, kv: d.withColumn(kv[0], F.expr(kv[1]).over(w)), aggregates.items(), df)
