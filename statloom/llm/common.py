"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A fixed set: the ASCII white space [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    cluster names one, else the folder set on the context. A local master without either
    gets a temporary folder, set once; on a cluster that is an error, as executors
    would not see the driver's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive lost executors.

    ``put`` writes a frame and returns it as read back; ``drop`` removes tables
    that are no longer read. What a lazy result still reads is removed when the driver
    ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        path, files = self._at(self.base)
        files.deleteOnExit(path)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path  # type: ignore[attr-defined]
        return back

    def all(self, *frames: DataFrame) -> DataFrame:
        """Several written tables of one schema as one."""
        return self.spark.read.schema(frames[0].schema).parquet(*(f._scratch_path for f in frames))

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, files = self._at(df._scratch_path)
            files.delete(path, True)


def ranked_within(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", salts: int = 64, total: str | None = None) -> DataFrame:
    """Adds ``out``, from 0 within ``keys`` in an order fixed by ``order``, and ``total``,
    if named, how many rows the keys have.

    Ranks run within a salt, a hash of the order columns, and are shifted by the counts
    of the salts before: a key that a third of all rows have is dealt over ``salts``
    tasks, and only counts meet by key. Rows that repeat take ranks one after another.
    Keys that are null are keys like others."""
    salt, own, shift, many = (fresh_name([*df.columns, out], s) for s in ("salt", "own_n", "shift", "many"))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, salt).agg(F.count("*").alias(own))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    as_ = {k: fresh_name([*df.columns, out, salt], f"key_{n}") for n, k in enumerate([*keys, salt])}
    shifts = counts.select(*[F.col(k).alias(a) for k, a in as_.items()], F.coalesce(F.sum(own).over(before), F.lit(0)).alias(shift), F.sum(own).over(whole).alias(many))
    within = Window.partitionBy(*keys, salt).orderBy(*order)
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in as_.items()]
    ranked = salted.withColumn(out, F.row_number().over(within) - 1).join(shifts, same)
    return ranked.select(*df.columns, (F.col(out) + F.col(shift)).cast("long").alias(out), *([F.col(many).alias(total)] if total else []))


def ascii_lower(col: Column | str) -> Column:
    """A-Z lower-cased, everything else as it is.

    lower() is the quick way and equal wherever no other upper- or title-case
    character occurs; only such texts go through translate()."""
    c = F.col(col) if isinstance(col, str) else col
    odd = c.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(odd, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of the taken ones, in any case."""
    low = {t.lower() for t in taken}
    name, k = stem, 0
    while name.lower() in low:
        k += 1
        name = f"{stem}_{k}"
    return name
