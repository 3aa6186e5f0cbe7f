"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import LOWER, UPPER, Scratch, fresh_name
from statloom.llm.components import connected_components

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Two-bit segments: a fingerprint's 32 counts of 0, 1 or 2.
SEGMENTS = 32
#: Chance that two unrelated counts of a two-bit segment are equal.
_MEET = 0.375


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """A hash per word shingle; of fewer words than ``width``, of all of them; none of none."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return np.array([], dtype="<u8")
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])] or [digest(joined, seed)]
    return np.array(hashes, dtype="<u8")


def hash_bits(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprint_bits(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no words."""
    return hash_bits(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``, a long with the SimHash of column ``text``; ``keep`` limits the
    other columns (all by default). Null and blank texts get 0."""
    keep = docs.columns if keep is None else keep
    raw = fresh_name(keep, "raw")
    given = docs.select(*keep, F.col(text).cast("binary").alias(raw))
    schema = docs.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_bits(x.as_py(), width) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*keep, out])

    return given.mapInArrow(run, schema)


def grid_blocks(n: int, distance: int = 4, aim: int = 256) -> tuple[int, int]:
    """(blocks, equal): into how many blocks the segments are dealt and how many of
    them two fingerprints must share. Links touch at most ``distance`` blocks, so
    any choice finds all of them; more blocks keep cells near ``aim`` members. Two
    shared blocks at least: up to some ten million fingerprints the rows are 15 each."""
    for equal in range(2, 9):
        blocks = distance + equal
        if n * _MEET ** (SEGMENTS * equal / blocks) <= aim:
            break
    return blocks, equal


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embed(fp: Column) -> Column:
    """Segment popcounts, packed: 32 two-bit counts in one long."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_cells(fps: DataFrame, blocks: int, equal: int) -> DataFrame:
    """One row per fingerprint and choice of ``equal`` blocks: the cell is the
    packed counts of the segments in those blocks."""
    masks = []
    for chosen in itertools.combinations(range(blocks), equal):
        masks.append(_as_long(sum(3 << (2 * s) for s in range(SEGMENTS) if s % blocks in chosen)))
    v = embed(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), v.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(cells).alias("c")).select("c.t", "c.cell", "fp")


def _forest(fp: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that join what the cell's fingerprints link: at most one less than
    there are fingerprints. ``side``: only pairs of different sides are compared.

    Rows are sorted by their total popcount (the embedding's one-segment form), so a
    row meets only the range within ``distance``; Hamming distance then decides."""
    total = np.bitwise_count(fp)
    order = np.argsort(total, kind="stable")
    fp, total = fp[order], total[order].astype(np.int64)
    side = side[order] if side is not None else None
    to = np.searchsorted(total, total + distance, side="right")
    label = np.arange(len(fp))
    out = []
    for i in range(len(fp) - 1):
        near = np.bitwise_count(fp[i + 1 : to[i]] ^ fp[i]) <= distance
        if side is not None:
            near &= side[i + 1 : to[i]] != side[i]
        for root in np.unique(label[i + 1 : to[i]][near]) if near.any() else ():
            if root != label[i]:
                j = i + 1 + int(np.flatnonzero(near & (label[i + 1 : to[i]] == root))[0])
                out.append((int(fp[i]), int(fp[j])))
                label[label == root] = label[i]
    return out


def _link_cells(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s > 1:
                    i, j = cols[2][s], cols[3][s]
                    for x, y in _forest(cols[5][s:e].view(np.uint64), cols[4][s:e] if i != j else None, distance):
                        a.append(_as_long(x))
                        b.append(_as_long(y))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            changed = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:4]:
                changed[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(changed)
            if len(cut):  # the last cell may go on in the next batch
                yield links(cols, np.concatenate(([0], cut)))
                cols = [c[cut[-1] :] for c in cols]
            held = cols
        if held is not None and len(held[0]):
            yield links(held, np.array([0, len(held[0])]))

    return run


def grid_links(fps: DataFrame, n: int, distance: int = 4, block: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most
    ``distance`` bits: a forest per grid cell, with the components of all links.

    Hamming distance is at least the Manhattan distance of the segment popcounts.
    Links therefore agree in all counts of enough blocks and meet in a cell. A cell
    of more than ``block`` fingerprints is dealt as pairs of blocks over tasks."""
    cells = grid_cells(fps, *grid_blocks(n, distance))
    big = cells.groupBy("t", "cell").count().where(F.col("count") > block)
    dealt = cells.join(big, ["t", "cell"], "left").withColumn("k", F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    rows = dealt.select("t", "cell", own.alias("side"), "fp", F.explode(pairs).alias("p")).select("t", "cell", "p.i", "p.j", "side", "fp")
    sorted_rows = rows.repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j")
    return sorted_rows.mapInArrow(_link_cells(distance), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints of at most ``distance`` differing bits link; component_id is the
    smallest doc_id reachable. Equal fingerprints are one node, so groups of copies
    cost one node however large they are. Null and blank texts have fingerprint 0
    and link like others. Rows that repeat are returned as often as they occur; a null
    doc_id is never the smallest unless its component has no other. An empty table
    gives no rows."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch.put(fingerprints(own, "text", width, "fp", ["doc_id"]))
    nodes = scratch.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = scratch.put(grid_links(nodes.select("fp"), nodes.count(), distance))
    star = connected_components(links, scratch=scratch)
    rooted = nodes.join(star.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id.

    Rows that repeat that doc_id stay once. Rows of null doc_id stay only where their
    group has no doc_id at all: one of each such fingerprint."""
    scratch = Scratch(docs.sparkSession, "neardedup")
    comp = scratch.put(simhash_components(docs, doc_id, text, width, distance))
    return keep_first(docs, comp, doc_id, lambda rows, mark: fingerprints(rows, text, width, mark), scratch)


def keep_first(docs: DataFrame, comp: DataFrame, doc_id: str, marked: Callable[[DataFrame, str], DataFrame], scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that near_dedup keeps, by (doc_id, fp, component_id);
    ``marked`` adds a column of that name with fp."""
    key = fresh_name(docs.columns, "kept")
    best = comp.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).count()
    kept = docs.join(best.select(key), F.col(doc_id) == F.col(key), "left_semi")
    again = scratch.put(best.where("count > 1").select(key))
    if not again.isEmpty():
        repeated = F.col(doc_id) == F.col(key)
        once = kept.join(again, repeated, "left_semi").dropDuplicates([doc_id])
        kept = kept.join(again, repeated, "left_anti").unionByName(once)
    if not comp.where("doc_id is null").isEmpty():
        alone = comp.where("component_id is null").select(F.col("fp").alias(key)).distinct()
        mark = fresh_name(docs.columns, "fp")
        nameless = marked(docs.where(F.col(doc_id).isNull()), mark)
        kept = kept.unionByName(nameless.join(alone, F.col(mark) == F.col(key), "left_semi").dropDuplicates([mark]).drop(mark))
    return kept


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_query(spark, sf_dir):
    """Fingerprint and component of every document; see ``simhash_components``."""
    from statloom.llm.common import table

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def expected_cells(n: int, distance: int = 4) -> dict[str, float]:
    """How the grid scales: rows per fingerprint and members per cell of unrelated ones."""
    blocks, equal = grid_blocks(n, distance)
    return {"rows": math.comb(blocks, equal), "members": n * _MEET ** (SEGMENTS * equal / blocks)}
