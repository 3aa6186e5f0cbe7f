"""Best-fit packing of tokenised documents into sequences of fixed length.

Pieces are placed in bulk-synchronous rounds over range-sorted pieces and gaps; see
``place``."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.chunks import ChunkIds, put_rows, slices
from statloom.llm.common import Scratch, ranked_within, table

#: A fixed set: Unicode white space, and the separators that only some tools take for it.
_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200C)))
#: A mark that stands before a chunk's blank or line break while texts are cut.
_CUT = "\ufdd0"
#: Per Python worker: the encoders of the files that it has used.
_encoders: dict = {}


def _special(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


class ChunkEncoder:
    """Ids of texts for a byte-level BPE file of the tokenizers library with its usual word
    pattern.

    A word never reaches over a blank or line break between two other characters, so
    texts are cut before those and each distinct chunk is encoded once. Texts in which
    such a cut could divide a run of white space, or that name special tokens, go whole.
    tiktoken does the merges: the file's ids are its ranks, and it is some times faster
    than the library with the same ids."""

    def __init__(self, vocab_json: str):
        import public_tokenizers
        import tiktoken

        spec = json.loads(vocab_json)
        back = {c: b for b, c in enumerate(_alphabet())}
        special = _special(spec)
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.chunks = ChunkIds(lambda chunks: list(map(self.enc.encode_ordinary, chunks)))
        other = "".join(f"\\x{{{ord(c):x}}}" for c in _SPACES if c not in " \n")
        # Three cuts in a row, two at the end, or a cut beside other white space.
        self.whole = f"<\\||{_CUT}|[ \n][ \n][ \n]|[ \n][ \n]\\z|[{other}][ \n]|[ \n][{other}]"

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of an array of texts, none null."""
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        cut = texts
        if len(whole):
            keep = np.ones(len(texts), dtype=bool)
            keep[whole] = False
            cut = pc.if_else(pa.array(keep), texts, "")
        for c in " \n":
            cut = pc.replace_substring(cut, c, _CUT + c)
        flat, offsets = self.chunks.gather(pc.split_pattern(cut, _CUT))
        own = {int(k): np.array(self.enc.encode(texts[int(k)].as_py(), allowed_special="all"), np.int32) for k in whole}
        return put_rows(flat, offsets, own)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()


def _alphabet() -> list[str]:
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with
    ``end_id`` after them, cut into pieces of ``capacity`` if longer, of which the first
    takes the remainder. Null and empty texts are the end id alone; rows that repeat give
    their pieces as often."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        vocab = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(vocab.value)
        for b in batches:
            for first, count in slices(pc.binary_length(b.column(1)).to_pylist(), batch_chars):
                sub = b.slice(first, count)
                flat, offsets = _encoders[path].encode_array(sub.column(1))
                flat = np.insert(flat, offsets[1:], end_id).astype("<u4")  # after each row's ids
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                parts = -(-sizes // capacity)
                row = np.repeat(np.arange(count), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                lead = sizes - (parts - 1) * capacity
                length = np.where(piece == 0, lead[row], capacity)
                start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
                at = (offsets[:-1][row] + start).tolist()
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())]
                cols = [sub.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, {fields}")


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high) of the lengths that rounds take together, longest first: by how many fit
    a sequence up to eight, then by halves."""
    out, high = [], capacity
    for k in range(2, 9):
        if high > capacity // k:
            out.append((capacity // k + 1, high))
            high = capacity // k
    while high > 0:
        low = high // 2 + 1
        out.append((low, high))
        high = low - 1
    return out


def stack_heights(lengths: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, str, int, int, int]]:
    """The sweep over range-sorted gaps and pieces, by class: (size, "gap" or "piece", place,
    height before, matched), in descending order of size, gaps before pieces.

    A piece's best fit is its successor, the least gap not below it. As each gap takes one
    piece a round, the sweep is a stack: gaps go on it and each piece takes the top one. A
    class's rows differ only in their rank, so heights before it say which levels of the
    stack its rows put or take: ranks resolve the conflicts."""
    out, height = [], 0
    for place, size in enumerate(sorted({*lengths, *gaps}, reverse=True)):
        if n := gaps.get(size):
            out.append((size, "gap", 2 * place, height, n))
            height += n
        if n := lengths.get(size):
            took = min(n, height)
            out.append((size, "piece", 2 * place + 1, height, took))
            height -= took
    return out


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _sweep(gaps: DataFrame, pieces: DataFrame, classes: list, capacity: int, slot: int | None) -> DataFrame:
    """(sequence_id, gap, n, offset): the pieces that gaps took and, once a sequence, what
    is left of its gap. Rows meet by level, where gaps and pieces take turns.

    With ``slot`` a gap takes part as as many slots of that size as it holds, the first of
    which has the remainder; its pieces then lie in order of slots."""
    spark = gaps.sparkSession
    put = _small(spark, [(s, p, h) for s, kind, p, h, _ in classes if kind == "gap"], "g_size long, place long, height long")
    take = _small(spark, [(s, p, h, m) for s, kind, p, h, m in classes if kind == "piece" and m], "p_size long, place long, height long, took long")
    gaps = gaps.withColumn("whole", F.col("gap")).withColumn("k", F.lit(0).cast("long"))
    if slot is not None:
        many = F.greatest(F.expr(f"whole div {slot}"), F.lit(1).cast("long"))
        gaps = gaps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        gaps = gaps.withColumn("gap", F.when(F.col("k") == 0, F.col("whole") - (many - 1) * slot).otherwise(F.lit(slot)).cast("long"))
    none = F.lit(None).cast("long")
    on = ranked_within(gaps, ["gap"], ["sequence_id", "k"], "r").join(put, F.col("gap") == F.col("g_size"))
    on = on.select((F.col("height") + F.col("r")).alias("level"), "place", "sequence_id", "k", "whole", none.alias("n"), F.lit(0).cast("long").alias("length"))
    off = pieces.join(take, F.col("length") == F.col("p_size")).where("r < took")
    off = off.select((F.col("height") - 1 - F.col("r")).alias("level"), "place", none.alias("sequence_id"), none.alias("k"), none.alias("whole"), "n", "length")
    w = Window.partitionBy("level").orderBy("place")
    met = on.unionByName(off).withColumn("next", F.lead(F.struct("n", "length")).over(w)).where("sequence_id is not null")
    met = met.select("sequence_id", "k", "whole", F.col("next.n").alias("n"), F.coalesce("next.length", F.lit(0).cast("long")).alias("length"))
    if slot is None:
        return met.select("sequence_id", (F.col("whole") - F.col("length")).alias("gap"), "n", (F.lit(capacity) - F.col("whole")).cast("long").alias("offset"))
    w = Window.partitionBy("sequence_id").orderBy("k")
    met = met.withColumn("upto", F.sum("length").over(w)).withColumn("last", F.lead("k").over(w).isNull())
    rows = met.select("sequence_id", F.when(F.col("last"), F.col("whole") - F.col("upto")).alias("gap"), "n", (F.lit(capacity) - F.col("whole") + F.col("upto") - F.col("length")).cast("long").alias("offset"))
    return rows.where("gap is not null or n is not null")


def _opened(pieces: DataFrame, each: int, made: int, capacity: int) -> DataFrame:
    """(sequence_id, gap, n, offset): pieces with a number u among those that fit nowhere,
    ``each`` to a new sequence; the gap stands beside a sequence's last piece."""
    w = Window.partitionBy("sequence_id").orderBy("u")
    rows = pieces.withColumn("sequence_id", F.expr(f"u div {each}") + F.lit(made))
    rows = rows.withColumn("upto", F.sum("length").over(w)).withColumn("last", F.lead("u").over(w).isNull())
    return rows.select("sequence_id", F.when(F.col("last"), F.lit(capacity) - F.col("upto")).cast("long").alias("gap"), "n", (F.col("upto") - F.col("length")).alias("offset"))


def place_rounds(numbered: DataFrame, sizes: dict[int, int], capacity: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(n, sequence_id, offset) for pieces numbered n in descending order of length, and
    the number of sequences.

    Bulk-synchronous best-fit: a band of lengths after the other, longest first. A round
    sorts the band's pieces and the open gaps by size and matches each piece with its
    successor among the gaps in one sweep (``stack_heights``); pieces that meet the same
    gap are told apart by rank. Gaps are then updated and the round repeats while a gap
    takes a piece: pieces that a first round left over outnumber the gaps, so that from
    the second on a gap takes as many as it has slots. What fits nowhere opens sequences in
    order of length. Each round is written, and only counts by length and by gap,
    ``capacity`` each, come to the driver."""
    spark = numbered.sparkSession
    first, at = {}, 0
    for size in sorted(sizes, reverse=True):
        first[size] = at
        at += sizes[size]
    made, gap_of, done = 0, {}, []
    open_ = None  # (sequence_id, gap) of all sequences that could still take a piece
    least = min(sizes, default=0)
    for low, high in bands(capacity):
        left = {s: n for s, n in sizes.items() if low <= s <= high}
        if not left:
            continue
        taken = dict.fromkeys(left, 0)
        band = numbered.where(F.col("length").between(low, high)).select("n", "length")
        slot = None
        while left:
            usable: dict[int, int] = {}
            for g, n in gap_of.items():
                if g >= low:
                    many = max(1, g // slot) if slot else 1
                    rest_of = g - (many - 1) * (slot or 0)
                    usable[rest_of] = usable.get(rest_of, 0) + n
                    if many > 1:
                        usable[slot] = usable.get(slot, 0) + n * (many - 1)
            widest = max((g for g in gap_of if g >= low), default=0)
            classes = stack_heights(left, usable)
            took = {s: m for s, kind, _, _, m in classes if kind == "piece"}
            rest = {s: n - took[s] for s, n in left.items() if n > took[s]}
            # Where no gap can take two of the band, what is left now opens sequences at once.
            last = not any(took.values()) or widest < 2 * low
            start = _small(spark, [(s, first[s] + taken[s]) for s in left], "b_size long, b_first long")
            mine = band.join(start, F.col("length") == F.col("b_size")).withColumn("r", F.col("n") - F.col("b_first")).where("r >= 0").select("n", "length", "r")
            parts = []
            if open_ is not None:
                wide = F.col("gap") >= low
                if any(took.values()):
                    parts.append(_sweep(open_.where(wide), mine, classes, capacity, slot))
                    parts.append(open_.where(~wide).select("sequence_id", "gap", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("offset")))
                else:
                    parts.append(open_.select("sequence_id", "gap", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("offset")))
            if last and rest:
                # A number among the pieces that open sequences: those of longer classes first.
                ahead, many = [], 0
                for s in sorted(rest, reverse=True):
                    ahead.append((s, took[s], many))
                    many += rest[s]
                fresh = mine.join(_small(spark, ahead, "o_size long, o_took long, o_ahead long"), F.col("length") == F.col("o_size")).where("r >= o_took").withColumn("u", F.col("r") - F.col("o_took") + F.col("o_ahead"))
                each = capacity // max(rest)
                parts.append(_opened(fresh, each, made, capacity))
                made += -(-many // each)
                rest = {}
            rows = parts[0]
            for other in parts[1:]:
                rows = rows.unionByName(other)
            rows = scratch.put(rows)
            done.append(rows)
            open_ = rows.where(F.col("gap") >= max(least, 1)).select("sequence_id", "gap")
            gap_of = {r["gap"]: r["count"] for r in open_.groupBy("gap").count().collect()}
            for s in left:
                taken[s] += took[s]
            left, slot = rest, max(rest, default=None)
    if not done:
        return numbered.limit(0).select("n", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")), 0
    return scratch.all(*done).where("n is not null").select("n", "sequence_id", "offset"), made


def number_by_length(pieces: DataFrame, sizes: dict[int, int], order: list[str]) -> DataFrame:
    """Adds n, from 0 in descending order of length; within a length by ranks, which a
    length that most pieces have takes from many tasks."""
    at, starts = 0, []
    for s in sorted(sizes, reverse=True):
        starts.append((s, at))
        at += sizes[s]
    ranked = ranked_within(pieces, ["length"], order, "__r")
    joined = ranked.join(_small(pieces.sparkSession, starts, "s_size long, s_first long"), F.col("length") == F.col("s_size"))
    return joined.select(*pieces.columns, (F.col("s_first") + F.col("__r")).alias("n"))


def place(pieces: DataFrame, capacity: int = 1024, order: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of 1 to ``capacity``.

    Pieces are numbered by length, placed by rounds (``place_rounds``) and joined with
    their places by number. ``order`` names columns that tell rows apart (all but arrays
    by default); rows that repeat are numbered one after the other. No rows, no result."""
    scratch = scratch or Scratch(pieces.sparkSession, "packing")
    order = order or [c for c in pieces.columns if c != "ids"]
    names = {c: "length" if c == "length" else f"in_{k}" for k, c in enumerate(pieces.columns)}
    sizes = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError(f"a length is not in 1 to {capacity}")
    if not sizes:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # Range-sorted, so that a round reads its band only.
    plain = number_by_length(pieces.select(*[F.col(c).alias(x) for c, x in names.items()]), sizes, [names[c] for c in order])
    numbered = scratch.put(plain.repartitionByRange("n").sortWithinPartitions("n"))
    places, _ = place_rounds(numbered, sizes, capacity, scratch)
    kept = [F.col(x).alias(c) for c, x in names.items() if c not in ("sequence_id", "offset")]
    return numbered.join(places, "n").select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every
    piece of every document; see ``tokenize_pieces`` and ``place``. Pieces are written
    once to the shared folder, so texts are tokenised once. Other columns are left out."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put(tokenize_pieces(docs, path, capacity, end_id, doc_id, text, with_ids))
    out = place(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"], scratch)
    return out


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place; see ``pack_documents``."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
