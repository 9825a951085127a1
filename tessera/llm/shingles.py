"""Hashed word shingles of many texts at once, their min-max signatures, and exact links between shingle sets.

Words are the runs of bytes other than ASCII white space after lower-casing A-Z. A word's hash is a polynomial in its
bytes modulo 2**64, taken for all words from one running sum, so no word is touched in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_P))


class _Powers:
    """Powers of a number modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.have = U(base), np.ones(1, U)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            self.have = np.concatenate([self.have, self.have * (self.have[-1:] * self.base)])
        return self.have[:n]


_up, _down = _Powers(_P), _Powers(_P_INV)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one entry more than texts)."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    space = _SPACE[buf]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[buf] * _up(len(buf)), dtype=U)])
    words = mix((total[ends] - total[begins]) * _down(len(buf))[begins] + (ends - begins).astype(U))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(begins, starts)


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and where each text's begin; fewer than ``width`` words make one shingle."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    weights = mix(np.arange(11, 11 + width, dtype=U) * U(_P))
    full = np.zeros(max(0, len(words) - width + 1), U)
    for j in range(width if len(full) else 0):
        full += mix(words[j : j + len(full)] ^ weights[j]) * (weights[j] | U(1))
    full = mix(full)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.empty(int(counts.sum()), U)
    begins = np.concatenate([[0], np.cumsum(counts)])
    long = n >= width
    if long.all():
        keep = np.repeat(at[:-1], counts) + (np.arange(len(out)) - np.repeat(begins[:-1], counts))
        return full[keep], begins
    for k in range(len(texts)):
        if long[k]:
            out[begins[k] : begins[k + 1]] = full[at[k] : at[k] + counts[k]]
        elif n[k]:
            w = words[at[k] : at[k + 1]]
            out[begins[k]] = mix((mix(w ^ weights[: len(w)]) * (weights[: len(w)] | U(1))).sum(dtype=U, keepdims=True) + U(len(w)))[0]
    return out, begins


def texts_of(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[str | None]:
    """A batch's texts, of which few are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield from batch.column(column).slice(at, rows).to_pylist()


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of encoded texts of about ``limit`` bytes; a longer text is a run of its own."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode()
        if held and size + len(b) > limit:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


# -- min-max signatures -----------------------------------------------------------------------------------------------
@functools.lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0xD1B54A32D192ED03))
    return (r[:n] >> U(32)).astype(np.uint32) | np.uint32(1), (r[n:] >> U(32)).astype(np.uint32)


def min_max_signature(hashes: np.ndarray, begins: np.ndarray, n_perm: int) -> np.ndarray:
    """texts x 2 n_perm: each permutation's least value and, from the same evaluations, its greatest. No text is empty."""
    h = (hashes >> U(32)).astype(np.uint32)
    mul, add = _permutations(n_perm)
    out = np.empty((2 * n_perm, len(begins) - 1), np.uint32)
    buf = np.empty_like(h)
    for k in range(n_perm):
        np.multiply(h, mul[k], out=buf)
        np.add(buf, add[k], out=buf)
        np.minimum.reduceat(buf, begins[:-1], out=out[k])
        np.maximum.reduceat(buf, begins[:-1], out=out[n_perm + k])
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands keys. Half of a band's rows are minima, half maxima of other permutations, which are independent."""
    n_perm = signature.shape[1] // 2
    half = rows // 2
    keys = np.zeros((len(signature), bands), U)
    for b in range(bands):
        low = [(b * half + j) % n_perm for j in range(half)]
        high = [n_perm + (b * (rows - half) + j + half * bands // 2 + 1) % n_perm for j in range(rows - half)]
        k = np.full(len(signature), b + 1, U)
        for c in (*low, *high):
            k = mix(k * U(_P) + signature[:, c].astype(U))
        keys[:, b] = k
    return keys


# -- exact links ------------------------------------------------------------------------------------------------------
class Forest:
    """Union-find over 0..n-1; ``labels`` may join some to begin with."""

    def __init__(self, n: int, labels: Iterable | None = None):
        self.up = list(range(n))
        first: dict = {}
        for i, x in enumerate(labels if labels is not None else ()):
            self.up[i] = first.setdefault(x, i)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


class Index:
    """Sizes of the intersections of one set with every set of a block, by an inverted list of the block's elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, U)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, s: np.ndarray, min_pct: int) -> np.ndarray:
        """Places of the sets with 100 * intersection >= min_pct * union; ``s`` is sorted and without repeats."""
        lo, hi = np.searchsorted(self.values, s, "left"), np.searchsorted(self.values, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((100 * both >= min_pct * (len(s) + self.sizes - both)) & (both > 0))


def links_within(ids: list, sets: list[np.ndarray], min_pct: int) -> list[tuple]:
    """Edges that join all sets of a block which chains of links connect."""
    forest = Forest(len(ids), ids)
    out = []
    if len(ids) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(ids[0], ids[1])] if 100 * both >= min_pct * (len(a) + len(b) - both) else []
    index = Index(sets)
    for i, s in enumerate(sets):
        out += [(ids[i], ids[j]) for j in index.linked(s, min_pct) if j < i and forest.join(i, int(j))]
    return out


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Key and columns of each run of rows with equal first ``n_keys`` columns, also where it crosses batches."""
    key, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, [list(c) for c in zip(*held, strict=True)]
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, [list(c) for c in zip(*held, strict=True)]


def run_batches(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Key and rows of each run of equal first ``n_keys`` columns (whole numbers), as Arrow columns."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)], 1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            now = tuple(keys[i].tolist())
            if now != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = now, []
            held.append(batch.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)
