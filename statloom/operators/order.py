"""Row order: ordering columns, group flags, retained values, queues, slices and sorts.

DataFrames have no order, so a table whose order matters carries ``__rid``. Windows run
within BY groups; only operators on the whole order need global numbers, and those come
from bucket counts, not from one sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "__rid"


def with_rid(df: DataFrame) -> DataFrame:
    """Adds the order in which a source is read, if it isn't there."""
    return df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())


def key_order(by: list[str]) -> list[Column]:
    """BY items, "-x" for descending; missing is the least value either way."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in by]


def plain(by: list[str]) -> list[str]:
    return [k.lstrip("-") for k in by]


def row_numbers(df: DataFrame, order: list[str], out: str = "__n", buckets: int = 256) -> DataFrame:
    """Adds 1, 2, ... by ``order``, without one task that sees all rows.

    Rows fall into buckets by their first order column: of a number or a time, by its
    approximate quantiles; of ``__rid``, by its partition; of text, by its first
    characters. Rank within the bucket plus the sizes of those before is the number. Only
    the bucket counts, ``buckets`` or so, are broadcast."""
    first, kind = plain(order)[0], df.schema[plain(order)[0]].dataType
    down = order[0].startswith("-")
    c = F.col(first)
    if first == RID:
        bucket = F.shiftright(c, 33).cast("long")
    elif isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = c.cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(c.cast("timestamp")).cast("double")
        cuts = df.select(F.percentile_approx(at, [k / buckets for k in range(1, buckets)], 4096)).first()[0]
        bucket = F.lit(0).cast("long") if not cuts else F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda v: v < at)), F.lit(0)).cast("long")
    else:
        code = lambda k: F.coalesce(F.ascii(F.substring(c.cast("string"), k, 1)), F.lit(0)).cast("long")
        bucket = code(1) * 1114112 + code(2)
    bucketed = df.withColumn("__b", F.when(c.isNull(), F.lit(-1).cast("long")).otherwise(bucket))
    counts = bucketed.groupBy("__b").agg(F.count("*").alias("__c"))
    turn = F.col("__b").desc() if down else F.col("__b").asc()
    shift = counts.withColumn("__s", F.coalesce(F.sum("__c").over(Window.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__s")
    w = Window.partitionBy("__b").orderBy(*key_order(order))
    return bucketed.withColumn(out, F.row_number().over(w)).join(shift, "__b").withColumn(out, (F.col(out) + F.col("__s")).cast("long")).drop("__b", "__s")


def by_flags(df: DataFrame, by: list[str], order: list[str] | None = None, notsorted: bool = False) -> DataFrame:
    """Adds first_<k> and last_<k> (0 or 1) for each BY column: whether the value of it or
    of a column before it changes from the row before, or to the row after.

    Rows are taken in BY order, then ``order``. ``notsorted``: runs in ``order`` alone;
    each contiguous run is a group."""
    order = order or [RID]
    names = plain(by)
    out = df
    if notsorted:
        w = Window.orderBy(*key_order(order))
        for k, name in enumerate(names):
            same_before = F.lit(True)
            same_after = F.lit(True)
            for prior in names[: k + 1]:
                same_before = same_before & F.lag(prior).over(w).eqNullSafe(F.col(prior))
                same_after = same_after & F.lead(prior).over(w).eqNullSafe(F.col(prior))
            edge = F.lag(F.lit(1)).over(w)
            edge_after = F.lead(F.lit(1)).over(w)
            out = out.withColumn(f"first_{name}", F.when(edge.isNull() | ~same_before, 1).otherwise(0)).withColumn(f"last_{name}", F.when(edge_after.isNull() | ~same_after, 1).otherwise(0))
        return out
    for k, name in enumerate(names):
        w = Window.partitionBy(*names[: k + 1]).orderBy(*(key_order(by[k + 1 :]) + key_order(order)))
        out = out.withColumn(f"first_{name}", F.when(F.row_number().over(w) == 1, 1).otherwise(0)).withColumn(f"last_{name}", F.when(F.lead(F.lit(1)).over(w).isNull(), 1).otherwise(0))
    return out


def accumulate(df: DataFrame, out: str, value: Column, by: list[str], order: list[str], start: float = 0.0) -> DataFrame:
    """The sum statement with RETAIN: a running total within BY groups; missing adds 0."""
    w = Window.partitionBy(*by).orderBy(*key_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.lit(start) + F.sum(F.coalesce(value, F.lit(0.0))).over(w))


def retain(df: DataFrame, out: str, value: Column, by: list[str], order: list[str]) -> DataFrame:
    """The last non-missing value so far within the BY group."""
    w = Window.partitionBy(*by).orderBy(*key_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def lag(df: DataFrame, out: str, value: str, by: list[str], order: list[str], n: int = 1, when: Column | None = None) -> DataFrame:
    """LAGn, executed in every row or only where ``when`` holds.

    The queue of a call advances only when it is executed: a conditional one holds the
    values of the rows where the condition held, and gives missing elsewhere."""
    if when is None:
        return df.withColumn(out, F.lag(value, n).over(Window.partitionBy(*by).orderBy(*key_order(order))))
    w = Window.partitionBy(*by, F.col("__on")).orderBy(*key_order(order))
    marked = df.withColumn("__on", F.coalesce(when, F.lit(False)))
    return marked.withColumn(out, F.when(F.col("__on"), F.lag(value, n).over(w))).drop("__on")


def dif(df: DataFrame, out: str, value: str, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, n).over(Window.partitionBy(*by).orderBy(*key_order(order))))


def slice_rows(df: DataFrame, order: list[str], firstobs: int = 1, obs: int | None = None) -> DataFrame:
    """firstobs= and obs= (the number of the last row), after any WHERE."""
    if firstobs == 1 and obs is not None:
        return df.orderBy(*key_order(order)).limit(obs)
    n = row_numbers(df, order)
    keep = F.col("__n") >= firstobs
    return n.where(keep if obs is None else keep & (F.col("__n") <= obs)).drop("__n")


def sort(df: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """Stable sort: ties keep their order."""
    return df.orderBy(*key_order(by), *key_order(order or ([RID] if RID in df.columns else [])))


def nodupkey(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each key, and DUPOUT='s rows."""
    w = Window.partitionBy(*plain(by)).orderBy(*key_order(order))
    marked = df.withColumn("__k", F.row_number().over(w))
    return marked.where("__k = 1").drop("__k"), marked.where("__k > 1").drop("__k")


def noduprec(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Drops a row that equals the one before it in sorted order, in all columns."""
    cols = [c for c in df.columns if c != RID and c not in order]
    w = Window.partitionBy(*plain(by)).orderBy(*key_order(order))
    here, before = F.struct(*cols), F.lag(F.struct(*cols)).over(w)
    return df.withColumn("__d", before.isNotNull() & before.eqNullSafe(here)).where("not __d").drop("__d")
