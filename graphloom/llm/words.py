"""Words and word n-grams as 64-bit hashes, computed on whole Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D.  Everything here is numpy
on the bytes of many documents at once; no Python object is made for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once.  A longer document is cut between words, so memory stays
#: bounded by this (or by the longest single word).
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size, step = 1, base & _MASK
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(step)
        step = step * step & _MASK
        size += more
    return out


class WordHasher:
    """Hashes the words of a byte buffer by differences of one polynomial prefix sum."""

    def __init__(self) -> None:
        self.space = _is_space()
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        self._grow(CHUNK + 1)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each word; document k is data[offsets[k]:offsets[k+1]]."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n + 1 > len(self.up):
            self._grow(n + 1)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # a document's start ends the word before it
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * self.down[starts])
        return hashes, np.searchsorted(offsets, starts, side="right") - 1


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker, which waits for other tasks, gives the memory it has freed back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, start: int, end: int, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one document of about CHUNK bytes, cut at white space."""
    while end - start > CHUNK:
        cut = start + CHUNK
        while cut < end:
            found = np.flatnonzero(space[data[cut : cut + 65536]])
            if len(found):
                cut += int(found[0])
                break
            cut += 65536
        cut = min(cut, end)
        yield start, cut
        start = cut
    yield start, end


def word_hashes(texts: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, documents, hashes, document of each hash from 0) for runs of whole documents."""
    data, offsets = buffers(texts)
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, side="right")) - 1)
        start, end = int(offsets[k]), int(offsets[stop])
        if end - start <= CHUNK:
            yield (k, stop - k, *hasher(data[start:end], offsets[k : stop + 1] - start))
        else:  # one long document
            parts = [hasher(data[s:e], np.array([0, e - s]))[0] for s, e in _cuts(data, start, end, hasher.space)]
            hashes = np.concatenate(parts)
            yield k, 1, hashes, np.zeros(len(hashes), np.int64)
        k = stop


def gram_sets(hashes: np.ndarray, owner: np.ndarray, docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document, sorted, and the start of each document's in them.

    A document of fewer than n words has one gram of all its words; one without words has none.
    """
    counts = np.bincount(owner, minlength=docs)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    grams, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= n:
        m = len(hashes) - n + 1
        sums = np.zeros(m, np.uint64)
        for k in range(n):
            sums += mix(hashes[k : k + m] ^ salt[k])
        whole = owner[:m] == owner[n - 1 :]
        grams, owners = mix(sums[whole]), owner[:m][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = []
        for d in short:
            h = hashes[firsts[d] : firsts[d + 1]]
            own.append(mix(mix(h ^ salt[: len(h)]).sum(keepdims=True) + np.uint64(len(h))))
        grams, owners = np.concatenate([grams, *own]), np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    grams, owners = grams[fresh], owners[fresh]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=docs))])
