"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines,
distributed connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, table
from statloom.llm.components import connected_components


#: As many listed cells, some 40 bytes each, are broadcast.
BIG_CELLS = 100_000


def plan_tables(n: int, threshold: float = 0.9, recall: float = 0.98, members: int = 512) -> tuple[int, int]:
    """(bits, tables): as many sign bits as leave about ``members`` unrelated vectors in
    a cell, and as many tables as find a pair right at ``threshold`` with chance ``recall``.
    A vector is sent once a table, so large cells, whose cosines are one quick matrix
    product, are worth fewer tables."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / members + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _numbers(vectors: DataFrame, embedding: str) -> Column:
    held = vectors.schema[embedding].dataType.simpleString()
    return F.col(embedding) if held == "array<float>" else F.col(embedding).cast("array<double>")


def _can_link(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _digest(v: Column) -> list[Column]:
    """128 bits that tell vectors that can link apart; null for others."""
    ok = _can_link(v)
    return [F.when(ok, F.xxhash64(F.size(v), v)).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), F.size(v), v)).alias("h2")]


def clean_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that can link: no null, non-finite or only-zero components.
    Components stay as they are if floats, else become doubles."""
    return vectors.select(F.col(vec_id).alias("vec_id"), _numbers(vectors, embedding).alias("v")).where(_can_link(F.col("v")))


def signatures(classes: DataFrame, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """Adds sigs, four bytes a table: the signs of ``bits`` random projections. Hyperplanes
    come from (seed, dimension), so every task draws the same; vectors of one dimension
    are projected together."""
    schema = classes.select("*", F.lit(b"").alias("sigs")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            sigs = np.zeros((b.num_rows, tables), dtype="<i4")
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    signs = _unit(v.take(pa.array(some)), int(dim)) @ planes[dim] > 0
                    sigs[some] = signs.reshape(-1, tables, bits) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s.tobytes() for s in sigs], pa.binary())], names=[*b.schema.names, "sigs"])

    return classes.mapInArrow(run, schema)


def _unit(rows: pa.Array, dim: int) -> np.ndarray:
    m = rows.flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _cell_links(t: int, ids: np.ndarray, n: np.ndarray, side: np.ndarray | None, sigs: np.ndarray, unit: np.ndarray, threshold: float, out: dict) -> None:
    """Counts each vector's partners and links a forest. A pair that also met in an
    earlier table was counted there, and is passed over."""
    size, label, step = len(ids), np.arange(len(ids)), 512
    partners = np.zeros(size, dtype=np.int64)
    for at in range(0, size, step):
        i, j = np.nonzero(unit[at : at + step] @ unit[at:].T >= threshold)
        i, j = i + at, j + at
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            new = np.ones(len(a), dtype=bool)
            for u in range(t):
                new &= sigs[a, u] != sigs[b, u]
            a, b = a[new], b[new]
            np.add.at(partners, a, n[b])
            np.add.at(partners, b, n[a])
            # Rows come in order of a: a row's partners of other labels join it at once.
            for x, s, e in zip(*_runs(a)):
                near = b[s:e]
                roots, first = np.unique(label[near], return_index=True)
                for root, k in zip(roots, first):
                    if root != label[x]:
                        out["kind"].append(1)
                        out["a"].append(int(ids[x]))
                        out["b"].append(int(ids[near[k]]))
                        label[label == root] = label[x]
    for k in np.flatnonzero(partners):
        out["kind"].append(0)
        out["a"].append(int(ids[k]))
        out["b"].append(int(partners[k]))


def _runs(a: np.ndarray):
    if not len(a):
        return [], [], []
    cut = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], cut))
    return a[starts], starts, np.concatenate((cut, [len(a)]))


def _link(threshold: float):
    names = ["kind", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        keys = ["dim", "t", "sig", "i", "j"]

        def work(rows: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
            out: dict = {k: [] for k in names}
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s > 1:
                    part = rows.slice(s, e - s).combine_chunks()
                    dim, t, i, j = (part[k][0].as_py() for k in ("dim", "t", "i", "j"))
                    sigs = np.stack([np.frombuffer(x.as_py(), "<i4") for x in part["sigs"]])
                    side = part["side"].to_numpy() if i != j else None
                    _cell_links(t, part["cid"].to_numpy(), part["n"].to_numpy(), side, sigs, _unit(part["v"].combine_chunks(), dim), threshold, out)
            return pa.RecordBatch.from_arrays([pa.array(out["kind"], pa.int32()), pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64())], names=names)

        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            changed = np.zeros(rows.num_rows, dtype=bool)
            for k in keys:
                c = rows[k].to_numpy()
                changed[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(changed)
            if len(cut):
                yield work(rows, np.concatenate(([0], cut)))
                rows = rows.slice(cut[-1])
            held = rows
        if held is not None and held.num_rows:
            yield work(held, np.array([0, held.num_rows]))

    return run


def cosine_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, recall: float = 0.98, block: int = 4096, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, found). classes: (h1, h2, cid, n) for each different clean vector: its
    digest, smallest vec_id and number of rows. found: (kind, a, b): kind 0 rows say that
    class a has b more linked vectors in other classes; kind 1 rows are links, of which
    each cell gives only a forest.

    Cells of more than ``block`` classes are dealt as pairs of blocks, so a dense group
    is spread over tasks and each holds two blocks at most. Only such cells are listed;
    the list is broadcast up to ``BIG_CELLS`` of them. A vector is shuffled once to its
    class and once a table, as it is held, with its signatures in four bytes a table; a
    cell's cosines are one matrix product in double precision."""
    scratch = scratch or Scratch(vectors.sparkSession, "embeddings")
    clean = clean_vectors(vectors, vec_id, embedding)
    hashed = clean.where("vec_id is not null").select("vec_id", *_digest(F.col("v")), "v")
    classes = scratch.put(hashed.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    own = hashed.withColumnRenamed("vec_id", "cid").join(classes, ["h1", "h2", "cid"])
    # A vec_id that repeats a vector gives its class once.
    one = own.where("n = 1").unionByName(own.where("n > 1").dropDuplicates(["h1", "h2"]))
    signed = scratch.put(signatures(one.select("cid", "n", "v"), bits, tables))
    sig = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("sigs"), t * 4 + 1, F.lit(4)))
    where = signed.select("cid", F.size("v").alias("dim"), F.posexplode(sig).alias("t", "sig"))
    big = scratch.put(where.groupBy("dim", "t", "sig").agg(F.count("*").alias("m")).where(F.col("m") > block))
    listed = F.broadcast(big) if big.count() <= BIG_CELLS else big
    rows = signed.select("cid", "n", "v", "sigs", F.size("v").alias("dim"), F.posexplode(sig).alias("t", "sig")).join(listed, ["dim", "t", "sig"], "left")
    k = F.ceil(F.coalesce("m", F.lit(1)) / block).cast("int")
    side = F.pmod(F.xxhash64("cid"), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(side, o).alias("i"), F.greatest(side, o).alias("j")))
    dealt = rows.select("dim", "t", "sig", side.alias("side"), "cid", "n", "v", "sigs", F.explode(pairs).alias("p"))
    dealt = dealt.select("dim", "t", "sig", "p.i", "p.j", "side", "cid", "n", "v", "sigs")
    cells = dealt.repartition("dim", "t", "sig", "i", "j").sortWithinPartitions("dim", "t", "sig", "i", "j")
    found = scratch.put(cells.mapInArrow(_link(threshold), "kind int, a long, b long"))
    scratch.drop(signed, big)
    return classes, found


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Pairs of cosine >= ``threshold`` link; pairs are found by sign hashing, at least
    ``recall`` of those right at the threshold and more of closer ones, and every found
    pair's cosine is exact. Equal vectors are one class, found whole: each of its rows
    links with the others. Vectors of different dimension don't link. Vectors that are
    null, empty, zero or have null or non-finite components have no links and stand
    alone. A vec_id on several different vectors is one node; rows without one have no
    links, and no component. Other columns are left out. No rows, no result."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    classes, found = cosine_links(vectors, vec_id, embedding, threshold, recall, scratch=scratch)
    star = connected_components(found.where("kind = 1").select("a", "b"), scratch=scratch)
    more = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("more"))
    known = (
        classes.join(more, "cid", "left")
        .join(star.withColumnRenamed("node", "cid"), "cid", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    # Vectors that can't link have no class; digests alone are shuffled.
    rows = vectors.select(F.col(vec_id).alias("vec_id"), *_digest(_numbers(vectors, embedding)))
    out = rows.join(known, ["h1", "h2"], "left")
    named = F.col("vec_id").isNotNull()
    comp = F.when(named, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), comp.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op4_query(spark, sf_dir):
    """Links, component and whether it is kept of each vector; see ``embedding_components``."""
    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.9)


#: Every pair, which only a small table allows.
OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) as (select vec_id, vec_id from v union select links.b, reach.r from reach join links on links.a = reach.id),
comp as (select id, min(r) as r from reach group by 1),
n as (select a, count(*) as k from links group by 1)
select v.vec_id, coalesce(n.k, 0)::bigint as n_links, comp.r as component_id, v.vec_id = comp.r as kept
from v join comp on comp.id = v.vec_id left join n on n.a = v.vec_id
"""
