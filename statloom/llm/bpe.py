"""BPE encoding and decoding in batched numpy merge rounds.

For vocabulary files of the tokenizers library of kind BPE with a byte-level alphabet
and word ends, whose texts are NFC-normalised, white space folded and lower-cased.
The path of the file is a parameter; the driver reads it and broadcasts its tables,
whose size is the vocabulary's."""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.chunks import ChunkIds, put_rows, slices
from statloom.llm.common import fresh_name, table

_NONE = np.iinfo(np.int64).max
#: Words of up to so many symbols are merged in rounds of one pair a word; longer ones in
#: rounds of one rank, which joins all its pairs at once.
ROUND_SYMBOLS = 64
#: Letters and numbers that Unicode has assigned since version 16, which the
#: tokenizers library still takes for unassigned. First and last code points, hexadecimal.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1
1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
3D000-3FC3F
"""


#: Capitals that the library lower-cases and unicodedata 15 doesn't: first and
#: last, and the first's lower case; hexadecimal.
LATER_LOWER = """
1C89-1C89 1C8A, A7CB-A7CB 264, A7CC-A7CC A7CD, A7CE-A7CE A7CF, A7D2-A7D2 A7D3,
A7D4-A7D4 A7D5, A7DA-A7DA A7DB, A7DC-A7DC 19B, 10D50-10D65 10D70, 16EA0-16EB8 16EBB
"""
_LOWER = {ord("Σ"): "σ"}
for _rule in LATER_LOWER.split(","):
    _first, _last, _to = (int(x, 16) for x in _rule.replace("-", " ").split())
    _LOWER |= {c: chr(_to + c - _first) for c in range(_first, _last + 1)}
#: A fixed value: the pair of Unicode 13 that the library's NFC doesn't compose.
_APART = "\U00011935", "\U00011930"


def nfc(text: str) -> str:
    if "".join(_APART) in text:
        first, second = _APART
        head, *rest = text.split(first + second)
        return nfc(head + first) + "".join(nfc(second + r + first) for r in rest[:-1]) + nfc(second + rest[-1])
    return unicodedata.normalize("NFC", text)


def word_pattern(file_pattern: str) -> regex.Pattern:
    """The file's pattern of words, with letters and numbers of the library's Unicode."""
    later = "".join("-".join(rf"\U{int(c, 16):08x}" for c in r.split("-")) for r in LATER.split())
    for kind in (r"\p{L}", r"\p{N}"):
        file_pattern = file_pattern.replace(kind, f"[{kind}--[{later}]]")
    return regex.compile(file_pattern, regex.V1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe:
    """A vocabulary's tables and a bounded memory of chunks that are already encoded."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The file's own pattern says what a word is.
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.word = word_pattern(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in alphabet], dtype=np.int64)
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # Where a pair is listed twice, the later rank holds, as in a map.
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = order[np.concatenate(([True], keys[order][1:] != keys[order][:-1]))]
        self.keys, self.rank, self.made = keys[keep], keep.astype(np.int64), made[keep]
        # Whether each pair comes after whatever makes its parts, as in trained files. Then
        # no merge makes a pair of lower rank, and all pairs of a rank can be joined at once.
        born = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(born, self.made, self.rank)
        self.ordered = bool((self.rank > np.maximum(born[self.keys // self.size], born[self.keys % self.size])).all())
        by_id = dict.fromkeys(range(self.size), "")
        by_id.update({i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()})
        self.tokens = [by_id[i] for i in range(self.size)]
        self.chunks = ChunkIds(self._encode_chunks)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index among the sorted pair keys, or -1."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the (not empty) words, merged together in rounds: every
        round finds each word's pair of lowest rank, leftmost of equals, and joins it."""
        out: list = [None] * len(words)
        long = [k for k, w in enumerate(words) if len(w) > ROUND_SYMBOLS and self.ordered]
        for k, ids in zip(long, self._by_rank([words[k] for k in long])):
            out[k] = ids
        short = [k for k in range(len(words)) if out[k] is None]
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        raw = np.frombuffer(b"".join(words[k] for k in short), dtype=np.uint8)
        word = np.repeat(np.arange(len(short)), sizes)
        sym = self.first[raw]
        sym[np.cumsum(sizes) - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        final: list = [None] * len(short)

        def ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and product of the pairs that begin at i."""
            nxt = np.minimum(i + 1, len(sym) - 1)
            at = self._find(sym[i], sym[nxt])
            ok = (at >= 0) & (word[nxt] == word[i]) & (nxt != i)
            return np.where(ok, self.rank[at], _NONE), self.made[at]

        rank, made = ranks(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, starts)
            live = low < _NONE
            if not live.all():  # words without a pair left are done
                ends = np.append(starts[1:], len(sym))
                for s, e in zip(starts[~live], ends[~live]):
                    final[word[s]] = sym[s:e].tolist()
                stay = np.repeat(live, ends - starts)
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                low = low[live]
            lengths = np.diff(np.append(starts, len(sym)))
            hits = np.flatnonzero(rank == np.repeat(low, lengths))
            hits = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))]
            sym[hits] = made[hits]
            keep = np.ones(len(sym), dtype=bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            here = place[hits]
            again = np.concatenate((here, np.maximum(here - 1, 0)))
            rank[again], made[again] = ranks(again)
        for k, ids in zip(short, final):
            out[k] = ids
        return out

    def _by_rank(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words, in rounds over the ranks that occur: a round joins all pairs
        of the lowest rank left, in all words, from the left where they overlap. Symbols
        stay in place and know their neighbours, so a round costs what it joins."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        n = len(sym)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1], left[ends - sizes] = -1, -1
        pair = np.full(n, _NONE)  # rank of the pair that begins here
        made = np.zeros(n, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(i: np.ndarray) -> None:
            pair[i] = _NONE
            i = i[right[i] >= 0]
            at = self._find(sym[i], sym[right[i]])
            i, at = i[at >= 0], at[at >= 0]
            pair[i], made[i] = self.rank[at], self.made[at]
            order = np.argsort(pair[i], kind="stable")
            i = i[order]
            for part in np.split(i, np.flatnonzero(np.diff(pair[i])) + 1) if len(i) else ():
                rank = int(pair[part[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks, rank)
                waiting[rank].append(part)

        look(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            i = np.unique(np.concatenate(waiting.pop(rank)))
            i = i[pair[i] == rank]
            if not len(i):
                continue
            # Of a chain of overlapping pairs every second is joined, from its first.
            chained = np.concatenate(([False], right[i[:-1]] == i[1:]))
            at = np.arange(len(i))
            i = i[(at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0]
            gone = right[i]
            sym[i], right[i] = made[i], right[gone]
            after = right[i]
            left[after[after >= 0]] = i[after >= 0]
            sym[gone], pair[gone] = -1, _NONE
            look(np.unique(np.concatenate((i, left[i][left[i] >= 0]))))
        stays = sym >= 0
        count = np.concatenate(([0], np.cumsum(stays)))
        flat = sym[stays]
        return [flat[count[e - s] : count[e]].tolist() for s, e in zip(sizes, ends)]

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Chunks hold no white space, which composes with nothing: they are normalised and
        lower-cased (by character: no final sigma) one by one."""
        found = []
        for c in chunks:
            c = c.lower() if c.isascii() else nfc(c).translate(_LOWER).lower()
            found.append([c] if c.isascii() and c.isalpha() else self.word.findall(c))
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(found)))
        ids = dict(zip(distinct, self.words([w.encode() for w in distinct])))
        return [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in found]

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of texts without special tokens. The empty chunks at a
        text's ends have no ids."""
        # The four separators are white space to Arrow, but not to the pattern.
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        chunks = self.chunks.gather(pc.utf8_split_whitespace(texts))
        if not pc.any(odd).as_py():
            return chunks
        own = {}
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            own[int(k)] = self.chunks.gather(pa.array([[c for c in regex.split(r"\s+", texts[int(k)].as_py()) if c]], pa.list_(pa.string())))[0]
        return put_rows(*chunks, own)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of an array of texts, none null; the strings of special
        tokens become their ids."""
        flat, offsets = self._gather(texts)
        replaced = {}
        if self.split_special:
            for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
                pieces = [p for p in self.split_special.split(texts[k].as_py()) if p]
                if any(p in self.special for p in pieces):
                    each, at = self._gather(pa.array(["" if p in self.special else p for p in pieces], pa.string()))
                    parts = [np.array([self.special[p]], np.int32) if p in self.special else each[at[n] : at[n + 1]] for n, p in enumerate(pieces)]
                    replaced[int(k)] = np.concatenate(parts)
        return put_rows(flat, offsets, replaced)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, offsets = self.encode_array(pa.array(texts, pa.string()))
        return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    def decode_array(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids: their tokens, joined by a blank. Unknown ids are left out."""
        if not hasattr(self, "names"):
            self.names = pa.array([t or None for t in self.tokens], pa.string())
        known = (flat >= 0) & (flat < len(self.names))
        words = self.names.take(pa.array(np.where(known, flat, 0), pa.int32()))
        if words.null_count or not known.all():
            keep = known & pc.is_valid(words).to_numpy(zero_copy_only=False)
            words, offsets = words.filter(pa.array(keep)), np.concatenate(([0], np.cumsum(keep)))[offsets]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


#: Per Python worker: the tables of the vocabularies that it has used.
_loaded: dict[str, Bpe] = {}


def _of(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        text = spark.sparkContext.broadcast(f.read())

    def get() -> Bpe:
        if path not in _loaded:
            _loaded[path] = Bpe(json.loads(text.value))
        return _loaded[path]

    return get


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None, batch_chars: int = 2_000_000) -> DataFrame:
    """Replaces column ``text`` by ``out``, its ids (array<int>), and, if named, adds
    ``decoded``, the text of the ids as ``bpe_decode`` gives it. Null and empty texts have
    no ids; special tokens are not added, but their strings are recognised. Texts are taken
    whole, about ``batch_chars`` bytes at a time. Rows may repeat; other columns pass
    through, but for those named as the new ones. No rows, no result."""
    new = [out] + [decoded] * (decoded is not None)
    keep = [c for c in df.columns if c not in (text, *new)]
    raw = fresh_name(keep, "raw")
    given = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(raw))
    schema = df.select(*keep).withColumn(out, F.lit(None).cast("array<int>")).schema
    schema = schema if decoded is None else schema.add(decoded, "string")
    bpe = _of(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(b.num_columns - 1)).to_pylist()
            for first, count in slices(sizes, batch_chars):
                sub = b.slice(first, count)
                flat, offsets = bpe().encode_array(sub.column(sub.num_columns - 1))
                cols = [*sub.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded is not None:
                    cols.append(bpe().decode_array(flat, offsets))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return given.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the tokens of the ids in the spelling of the vocabulary, joined by
    a blank, as the tokenizers library decodes where the file has no decoder. Null ids
    give the empty text; null and unknown ids within are left out, as there."""
    keep = [c for c in df.columns if c != out]
    schema = df.select(*keep).withColumn(out, F.lit("")).schema
    at = keep.index(ids)
    bpe = _of(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_pylist()
            for first, count in slices(sizes, 500_000):
                sub = b.slice(first, count)
                rows = pa.array(sub.column(at).to_pylist(), pa.list_(pa.int32()))
                rows = pc.fill_null(rows, pa.scalar([], rows.type)) if rows.null_count else rows
                flat = pc.fill_null(rows.flatten(), -1).to_numpy()
                yield pa.RecordBatch.from_arrays([*sub.columns, bpe().decode_array(flat, rows.offsets.to_numpy().astype(np.int64))], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


def op6_query(spark, sf_dir):
    """Counts and digests of ids and decoded texts; texts are taken as by ``bpe_encode``."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_encode(docs, path, decoded="decoded")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
