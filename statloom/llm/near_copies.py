"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides: SimHash fingerprints within a few bits (the grid of
simhash.py) and banded minimum hashes, which find the pairs that differ in more bits.
The exact similarity decides, among all texts that candidates join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, fresh_name
from statloom.llm.components import connected_components
from statloom.llm.simhash import grid_links, hash_bits, keep_first, shingle_hashes

#: A pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^30 = 0.999993.
BANDS, ROWS = 30, 5
#: Sizes of at most so many large groups, some 20 bytes each, are broadcast.
LARGE_GROUPS = 100_000
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_id(shingles: np.ndarray) -> int:
    """One long for a set of shingles, so that copies are one node; 0 for none."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 1)))) if len(shingles) else 0


def band_keys(shingles: np.ndarray) -> list[int]:
    """A hash per band of the set's minimum hashes."""
    if not len(shingles):
        return []
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0))
    raw = least.astype("<u8").tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _marks(width: int):
    """(doc_id, text) as (doc_id, node, fp, keys); fp is null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, keys = [], [], []
            for x in b.column(1):
                h = shingle_hashes(x.as_py(), width)
                own = np.unique(h)
                node.append(set_id(own))
                fp.append(hash_bits(h) if len(h) else None)
                keys.append(band_keys(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "keys"])

    return run


def _with_node(docs: DataFrame, text: str, width: int, out: str, shingles: str | None = None) -> DataFrame:
    """Adds ``out``, the node of column ``text``, and, if named, its set of shingles."""
    keep = docs.columns
    raw = fresh_name(keep, "raw")
    schema = docs.withColumn(out, F.lit(0).cast("long")).schema
    schema = schema if shingles is None else schema.add(shingles, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), width) for x in b.column(b.num_columns - 1)]
            cols = [*b.columns[:-1], pa.array([set_id(s) for s in sets], pa.int64())]
            if shingles is not None:
                cols.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, F.col(text).cast("binary").alias(raw)).mapInArrow(run, schema)


def similar_forest(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Positions of sets that link: a forest with the components of all pairs of
    similarity ``least`` or more. ``side``: only pairs of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        open_ = label[i + 1 :] != label[i]
        if side is not None:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        mine = np.zeros(len(every), dtype=bool)
        mine[at[starts[i] : starts[i] + sizes[i]]] = True
        common = np.add.reduceat(mine[at[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        near = open_ & (common / (sizes[i] + sizes[i + 1 :] - common) >= least)
        for j in i + 1 + np.flatnonzero(near):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _link_groups(least: float):
    """(component, i, j, side, node, shingles), in order of the first three, as links (a, b)."""

    def links(t: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        i, j, side, node = (t.column(k).to_numpy() for k in ("i", "j", "side", "node"))
        a, b = [], []
        for s, e in zip(cut[:-1], cut[1:]):
            if e - s > 1:
                sets = [np.frombuffer(x.as_py(), dtype="<u8") for x in t.column("shingles").slice(s, e - s)]
                for x, y in similar_forest(sets, side[s:e] if i[s] != j[s] else None, least):
                    a.append(int(node[s + x]))
                    b.append(int(node[s + y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            changed = np.zeros(t.num_rows, dtype=bool)
            for k in ("component", "i", "j"):
                c = t.column(k).to_numpy()
                changed[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(changed)
            if len(cut):  # the last group may go on in the next batch
                yield links(t, np.concatenate(([0], cut)))
                t = t.slice(cut[-1])
            held = t
        if held is not None and held.num_rows:
            yield links(held, np.array([0, held.num_rows]))

    return run


def candidate_links(marked: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """Links (a, b) between nodes, some per node: a path joins all nodes of a band's
    bucket, and all whose fingerprints are within ``distance`` bits."""
    cells = scratch.put(marked.select(F.explode("keys").alias("key"), "node").distinct())
    shared = cells.groupBy("key").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m < x")
    banded = cells.join(shared.select("key", "m"), "key").where("node > m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    fps = marked.where("fp is not null").select("fp", "node").distinct()
    first = scratch.put(fps.groupBy("fp").agg(F.min("node").alias("m")))
    equal = fps.join(first, "fp").where("node > m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    grid = scratch.put(grid_links(first.select("fp"), first.count(), distance).withColumnsRenamed({"a": "f", "b": "g"}))
    ends = grid.join(first.select(F.col("fp").alias("f"), F.col("m").alias("a")), "f").join(first.select(F.col("fp").alias("g"), F.col("m").alias("b")), "g")
    return banded.union(equal).union(ends.select("a", "b"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, distance: int = 4, block: int = 128) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; fp is the id of its set of shingles.

    Texts link whose sets of ``width``-word shingles have that Jaccard similarity;
    component_id is the smallest doc_id reachable. Equal sets are one node, and texts
    without words are one, too, which links with no other. All that candidates join is
    compared exactly; a group of more than ``block`` nodes is dealt as pairs of blocks."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    marked = scratch.put(own.mapInArrow(_marks(width), f"doc_id {kind}, node long, fp long, keys array<long>"))
    nodes = scratch.put(marked.groupBy("node").agg(F.min("doc_id").alias("first_id")))
    maybe = scratch.put(connected_components(candidate_links(marked, scratch, distance), scratch=scratch))
    asked = nodes.join(maybe, "node").select(F.col("first_id").alias("doc_id")).distinct()
    texts = own.alias("o").join(asked.alias("q"), F.col("o.doc_id").eqNullSafe(F.col("q.doc_id")), "left_semi").select("text")
    sets = _with_node(texts, "text", width, "node", "shingles").drop("text").dropDuplicates(["node"])
    sizes = scratch.put(maybe.groupBy("component").count().where(F.col("count") > block))
    # Rows of a large group need not meet to learn its size.
    sizes = F.broadcast(sizes) if sizes.count() <= LARGE_GROUPS else sizes
    dealt = maybe.join(sizes, "component", "left").withColumn("k", F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int"))
    side = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(side, o).alias("i"), F.greatest(side, o).alias("j")))
    rows = sets.join(dealt, "node").select("component", "node", "shingles", side.alias("side"), F.explode(pairs).alias("p"))
    rows = rows.select("component", "p.i", "p.j", "side", "node", "shingles")
    grouped = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = scratch.put(grouped.mapInArrow(_link_groups(similarity), "a long, b long"))
    star = connected_components(links, scratch=scratch)
    rooted = nodes.join(star, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = rooted.join(smallest, "root").select("node", "component_id")
    return marked.join(by_node, "node").select("doc_id", F.col("node").alias("fp"), "component_id")


def dedup_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id.
    Rows that repeat a doc_id or have none stay as in simhash.near_dedup."""
    scratch = Scratch(docs.sparkSession, "neardedup")
    comp = scratch.put(similar_components(docs, doc_id, text, width, similarity))
    return keep_first(docs, comp, doc_id, lambda rows, mark: _with_node(rows, text, width, mark), scratch)
