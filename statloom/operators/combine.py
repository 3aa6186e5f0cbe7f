"""Combining datasets: SET, MERGE, UPDATE, MODIFY and point lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.order import RID, key_order, row_numbers, with_rid


def _all_columns(frames: list[DataFrame], skip=()) -> list[str]:
    seen: dict[str, str] = {}
    for df in frames:
        for c in df.columns:
            if c not in skip:
                seen.setdefault(c.lower(), c)
    return list(seen.values())


def concatenate(*frames: DataFrame) -> DataFrame:
    """SET a b: one after the other; missing where a source lacks a variable. The order is
    (__src, __rid)."""
    tagged = [with_rid(df).withColumn("__src", F.lit(k)) for k, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def interleave(by: list[str], *frames: DataFrame) -> DataFrame:
    """SET a b; BY k: in BY order; ties by source, then by the source's order."""
    return concatenate(*frames).orderBy(*key_order(by), "__src", RID)


def one_to_one(*frames: DataFrame, order: list[list[str]]) -> DataFrame:
    """Several SETs in a step: row by row, up to the shortest; later values win."""
    return _by_position(frames, order, "inner")


def merge_positional(*frames: DataFrame, order: list[list[str]]) -> DataFrame:
    """MERGE without BY: row by row to the longest; an exhausted source's own variables
    are missing."""
    return _by_position(frames, order, "full")


def _by_position(frames, order, how):
    numbered = [row_numbers(df, o).drop(RID) for df, o in zip(frames, order)]
    out = numbered[0]
    for k, df in enumerate(numbered[1:], 1):
        shared = [c for c in df.columns if c in out.columns and c != "__n"]
        right = df.select(F.col("__n"), F.lit(True).alias("__has"), *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in df.columns if c != "__n"])
        out = out.join(right, "__n", how)
        for c in shared:
            out = out.withColumn(c, F.when(F.col("__has"), F.col(f"__r_{c}")).otherwise(F.col(c))).drop(f"__r_{c}")
        out = out.drop("__has")
    return out


def merge_by(frames: dict[str, DataFrame], by: list[str], order: dict[str, list[str]], flags: bool = True) -> DataFrame:
    """MERGE a b ...; BY k: match-merge.

    Within a key the sources go side by side by position, never as a product; there are as
    many rows as the longest source has. A variable has the value of the rightmost source
    that has a row there; past the end of all that hold it, the last value stays. in_<name>
    says whether the source has the key. Missing keys match missing keys.

    One shuffle, on the key: the sources are stacked, numbered and put side by side by
    windows and aggregates that the key's partitioning serves."""
    names = list(frames)
    holders: dict[str, list[int]] = {}
    kinds: dict[str, object] = {}
    for k, name in enumerate(names):
        for f in frames[name].schema:
            if f.name not in by and f.name != RID:
                holders.setdefault(f.name, []).append(k)
                kinds.setdefault(f.name, f.dataType)
    stacked = []
    for k, name in enumerate(names):
        df = frames[name]
        row = F.struct(*[(F.col(v).cast(kinds[v]) if k in hs else F.lit(None).cast(kinds[v])).alias(v) for v, hs in holders.items()]) if holders else F.struct(F.lit(1).alias("__x"))
        key = F.struct(*key_order_values(order[name]))
        stacked.append(df.select(*by, F.lit(k).alias("__src"), key.alias("__o"), row.alias("__row")))
    # Order keys of different sources may differ in type, so each is ranked apart.
    ranked = []
    for df in stacked:
        w = Window.partitionBy(*by).orderBy("__o")
        ranked.append(df.withColumn("__n", F.row_number().over(w)).drop("__o"))
    both = reduce(DataFrame.unionByName, ranked)
    at = both.groupBy(*by, "__n").agg(*[F.max(F.when(F.col("__src") == k, F.struct("__row"))).alias(f"__s{k}") for k in range(len(names))])
    w = Window.partitionBy(*by).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    cols = []
    for v, hs in holders.items():
        live = F.coalesce(*[F.when(F.col(f"__s{k}").isNotNull(), F.struct(F.col(f"__s{k}.__row.{v}").alias("v"))) for k in reversed(hs)])
        cols.append(F.last(live, ignorenulls=True).over(w)["v"].alias(v))
    ins = [F.max(F.col(f"__s{k}").isNotNull().cast("int")).over(whole).alias(f"in_{name}") for k, name in enumerate(names)] if flags else []
    return at.select(*by, F.col("__n"), *cols, *ins)


def key_order_values(order: list[str]):
    return [F.col(c) for c in order]


def update(master: DataFrame, trans: DataFrame, by: list[str], order: list[str], missingcheck: bool = True) -> DataFrame:
    """UPDATE master trans; BY k: non-missing transactions overlay the master row, in
    order, and collapse to one row a key; keys only in the transactions are added.
    ``missingcheck`` False is UPDATEMODE=NOMISSINGCHECK: missing overlays, too."""
    vars_ = [c for c in trans.columns if c not in by and c != RID and c not in order]
    key = F.struct(*order)
    pick = []
    for v in vars_:
        value = F.struct(F.col(v).alias("v"))
        pick.append(F.max_by(value, F.when(F.col(v).isNotNull() if missingcheck else F.lit(True), key)).alias(f"__t_{v}"))
    # max_by skips rows whose order is null: a missing value never overlays.
    last = trans.groupBy(*by).agg(*pick, F.lit(True).alias("__hit"))
    cond = reduce(lambda a, b: a & b, [F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by])
    j = master.alias("m").join(last.alias("t"), cond, "full")
    cols = [F.coalesce(F.col(f"m.{k}"), F.col(f"t.{k}")).alias(k) for k in by]
    for v in [c for c in master.columns if c not in by and c != RID]:
        cols.append((F.when(F.col(f"t.__t_{v}").isNotNull(), F.col(f"t.__t_{v}.v")).otherwise(F.col(f"m.{v}")) if v in vars_ else F.col(f"m.{v}")).alias(v))
    cols += [F.col(f"t.__t_{v}.v").alias(v) for v in vars_ if v not in master.columns]
    return j.select(*cols)


def modify(master: DataFrame, trans: DataFrame, by: list[str], order: list[str], remove: str | None = None) -> DataFrame:
    """MODIFY master trans; BY k: the master's matching rows are replaced by the
    transactions' non-missing values; unmatched transactions change nothing. ``remove``
    is a condition on the transaction that deletes the row instead."""
    keys = master.select(*by).distinct()
    hit = trans.join(keys, reduce(lambda a, b: a & b, [trans[k].eqNullSafe(keys[k]) for k in by]), "left_semi")
    gone = hit.where(remove).select(*by).distinct() if remove else None
    out = update(master, hit.where(f"not coalesce({remove}, false)") if remove else hit, by, order)
    if gone is not None:
        out = out.join(gone, reduce(lambda a, b: a & b, [out[k].eqNullSafe(gone[k]) for k in by]), "left_anti")
    return out


def point_lookup(driver: DataFrame, table: DataFrame, point: str, order: list[str]) -> DataFrame:
    """SET table POINT=: the row of that number beside each row of the driver."""
    numbered = row_numbers(table, order).drop(RID)
    return driver.join(numbered, driver[point].cast("long") == numbered["__n"], "left").drop("__n")


def hash_find(df: DataFrame, lookup: DataFrame, keys: list[str], data: list[str], order: list[str] | None = None, multidata: bool = False, duplicate: str = "first") -> DataFrame:
    """Hash object find(): the lookup's data beside the rows, and rc (0 found, 160038 not).

    Of equal keys the first added stays (``duplicate`` "replace": the last); ``multidata``
    keeps all, as find_next() would go through them. Spark picks broadcast or shuffle by
    the lookup's size."""
    side = lookup
    if not multidata:
        turn = key_order(order or keys)
        w = Window.partitionBy(*keys).orderBy(*(turn if duplicate == "first" else [F.desc(c) for c in (order or keys)]))
        side = lookup.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    side = side.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[F.col(d).alias(f"__d_{d}") for d in data], F.lit(0).alias("__f"))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    j = df.join(side, cond, "left").withColumn("rc", F.when(F.col("__f").isNotNull(), 0).otherwise(160038))
    for d in data:
        j = j.withColumn(d, F.when(F.col("__f").isNotNull(), F.col(f"__d_{d}")).otherwise(F.col(d) if d in df.columns else F.lit(None)))
    return j.drop("__f", *[f"__h_{k}" for k in keys], *[f"__d_{d}" for d in data])


def append(base: DataFrame, data: DataFrame, force: bool = False) -> DataFrame:
    """PROC APPEND: the data's rows after the base's, in the base's columns. Other columns,
    or other types, need FORCE, which drops them or makes them missing."""
    extra = [c for c in data.columns if c.lower() not in {b.lower() for b in base.columns}]
    kinds = {f.name.lower(): f.dataType.typeName() for f in data.schema}
    odd = [f.name for f in base.schema if f.name.lower() in kinds and ("string" == kinds[f.name.lower()]) != ("string" == f.dataType.typeName())]
    if (extra or odd) and not force:
        raise ValueError(f"append needs FORCE: {extra + odd}")
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name.lower() not in kinds or f.name in odd else F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema]
    return base.unionByName(data.select(*cols))
