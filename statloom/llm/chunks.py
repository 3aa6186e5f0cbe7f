"""Ids of many chunks of text at once: each distinct chunk is encoded once and kept, and
texts become ids by Arrow dictionaries and numpy gathers instead of a loop over words."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa


class ChunkIds:
    """A bounded memory of the ids of chunks. ``encode`` gives the ids of a list of distinct
    chunks. What is kept is cleared where its characters and ids pass ``most``; a call's own
    chunks are always there, however many."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 6_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.size, self.held = 0, 0
        self.flat = np.zeros(1 << 12, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _learn(self, fresh: list[str]) -> None:
        found = self.encode(fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        need = self.size + int(sizes.sum())
        if need > len(self.flat):
            grown = np.zeros(max(need, 2 * len(self.flat)), dtype=np.int32)
            grown[: self.size] = self.flat[: self.size]
            self.flat = grown
        self.flat[self.size : need] = np.fromiter(itertools.chain.from_iterable(found), np.int32, need - self.size)
        self.slot.update(zip(fresh, range(len(self.slot), len(self.slot) + len(fresh))))
        self.ends = np.concatenate((self.ends, self.size + np.cumsum(sizes)))
        self.size = need
        self.held += sum(map(len, fresh)) + int(sizes.sum())

    def gather(self, chunks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of rows that are lists of chunks."""
        if self.held > self.most:
            self._clear()
        bounds = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        words = coded.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.slot]
        if fresh:
            self._learn(fresh)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        at = slots[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return self.flat[where], np.concatenate(([0], ends))[bounds]


def slices(sizes: list[int], most: int):
    """(first, count) of consecutive rows whose sizes add up to about ``most`` at most."""
    at, total = 0, 0
    for k, w in enumerate(sizes):
        w = w or 0
        if k > at and total + w > most:
            yield at, k - at
            at, total = k, 0
        total += w
    if at < len(sizes):
        yield at, len(sizes) - at


def put_rows(flat: np.ndarray, offsets: np.ndarray, rows: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of (flat, offsets) with some of them replaced."""
    if not rows:
        return flat, offsets
    parts, at = [], 0
    sizes = np.diff(offsets)
    for k in sorted(rows):
        parts += [flat[offsets[at] : offsets[k]], rows[k]]
        sizes[k], at = len(rows[k]), k + 1
    parts.append(flat[offsets[at] :])
    return np.concatenate(parts).astype(flat.dtype, copy=False), np.concatenate(([0], np.cumsum(sizes)))
