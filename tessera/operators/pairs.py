"""Passes over all pairs of rows, in blocks on the executors.

The rows of a table (not their pairs) are read once and sent to every executor. A task takes blocks of rows, meets all rows
in tiles of bounded size and returns a few numbers a row, so no matrix of all pairs exists anywhere. The solver
iterates such passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import SparkSession

from tessera.core import one_thread
from tessera.operators.neighbors import CELLS, near_pairs

#: Rows of a block, and rows that it meets at a time.
ROWS, TILE = 256, 4096
#: The same of kernels, whose tiles are gone through several times and are to stay in a core's cache.
KERNEL_TILE = 512
#: Part of its own kernel that a row has in common with a like one.
LIKE = 0.8


def tiles(n: int, step: int = TILE) -> Iterator[slice]:
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def nearest_rows(q: np.ndarray, x: np.ndarray, k: int, metric: str = "euclidean", own: int | None = None, p: float = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest rows of ``x``, ties to the first; ``own`` is the place of q's first row in x, which isn't its own neighbour."""
    k = min(k, len(x) - (own is not None))
    if own is None and not (whole := np.isfinite(q).all(1)).all():  # a row with a missing value is as far from all: the first ones
        dist, at = np.full((len(q), k), np.nan), np.tile(np.arange(k), (len(q), 1))
        dist[whole], at[whole] = nearest_rows(q[whole], x, k, metric, None, p)
        return dist, at
    dist, at = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    for rows in tiles(len(q), ROWS):
        best = None
        for t in tiles(len(x)):
            i, j, d = near_pairs(q[rows], x[t], metric, p, k + (own is not None), None)
            j = j + t.start
            if own is not None:
                other = j != i + rows.start + own
                i, j, d = i[other], j[other], d[other]
            if best is not None:
                i, j, d = (np.concatenate(v) for v in zip(best, (i, j, d), strict=True))
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            best = i[first], j[first], d[first]
        if best is not None:
            dist[rows], at[rows] = best[2].reshape(-1, k), best[1].reshape(-1, k)
    return dist, at


def nearest_place(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return nearest_rows(q, x, 1)[1][:, 0]


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by inner products; those that would keep few digits, by differences."""
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)
    low = 1e-6 * d
    d -= 2 * (q @ x.T)
    i, j = np.nonzero(d < low)
    for t in tiles(len(i), max(1, CELLS // q.shape[1])):
        d[i[t], j[t]] = ((q[i[t]] - x[j[t]]) ** 2).sum(1)
    return d


def against(tile: Callable[[np.ndarray, np.ndarray], np.ndarray], q: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The matrix of ``tile`` of rows ``q`` and ``x``, times ``v``, in tiles."""
    out = np.zeros((len(q), *v.shape[1:]))
    for a in tiles(len(q), ROWS):
        for t in tiles(len(x), KERNEL_TILE):
            out[a] += tile(q[a], x[t]) @ v[t]
    return out


class Pairs:
    """All rows ``x`` of a table, ready to meet each other on the executors."""

    def __init__(self, spark: SparkSession, x: np.ndarray):
        self.spark, self.x, self.n = spark, x, len(x)
        self._shared = spark.sparkContext.broadcast(np.ascontiguousarray(x, float))

    def map(self, fn: Callable[[slice, np.ndarray, tuple], np.ndarray], *state: np.ndarray, rows: int = ROWS, count: int | None = None) -> np.ndarray:
        """The rows that ``fn(block, x, state)`` gives for each block of ``count`` rows, all of x if not given, in order."""
        n = self.n if count is None else count
        return self.gather(fn, *state, rows=rows, count=n).reshape(n, -1)

    def gather(self, fn: Callable[[slice, np.ndarray, tuple], np.ndarray], *state: np.ndarray, rows: int = ROWS, count: int | None = None) -> np.ndarray:
        """The same for blocks that give any number of values, one after the other."""
        n, x = self.n if count is None else count, self._shared
        sc = self.spark.sparkContext
        sent = sc.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for b in batches:
                for i in b.column(0).to_pylist():
                    got = np.ascontiguousarray(fn(slice(i * rows, min(n, (i + 1) * rows)), x.value, sent.value), float)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=["i", "v"])

        blocks = -(-n // rows)
        got = self.spark.range(0, blocks, 1, min(blocks, 4 * sc.defaultParallelism)).mapInArrow(run, "i long, v binary").toArrow().sort_by("i")
        flat = np.concatenate([np.frombuffer(v.as_buffer(), float) for v in got["v"]])
        sent.destroy()
        return flat

    def product(self, tile: Callable[[np.ndarray, np.ndarray], np.ndarray], v: np.ndarray, own: bool = True) -> np.ndarray:
        """The matrix of ``tile`` of all pairs, times ``v``; a row's pair with itself counts 0 unless ``own``."""

        def fn(at, x, state):
            out = np.zeros((at.stop - at.start, state[0].shape[1]))
            for t in tiles(len(x), KERNEL_TILE):
                k = tile(x[at], x[t])
                if not own:
                    both = np.arange(max(at.start, t.start), min(at.stop, t.stop))
                    k[both - at.start, both - t.start] = 0
                out += k @ state[0][t]
            return out

        return self.map(fn, np.ascontiguousarray(v.reshape(self.n, -1))).reshape(v.shape)

    def nearest(self, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of each row's k nearest others."""
        out = self.map(lambda at, x, state: np.hstack(nearest_rows(x[at], x, k, metric, at.start)))
        return out[:, : out.shape[1] // 2], out[:, out.shape[1] // 2 :].astype(np.int64)

    def close(self) -> None:
        self._shared.destroy()


def _like(pairs: Pairs, tile: Callable[[np.ndarray, np.ndarray], np.ndarray], c: np.ndarray, ridge: np.ndarray, most: int = 500) -> Callable[[np.ndarray], np.ndarray]:
    """Solves the blocks of K - c c' + diag(ridge) of like rows: see ``LIKE``."""

    def first(at, x, state):
        out, own = np.arange(at.start, at.stop), np.einsum("ii->i", tile(x[at], x[at]))
        for t in tiles(at.stop, KERNEL_TILE):
            k = tile(x[at], x[t]) >= LIKE * own[:, None]
            out = np.minimum(out, np.where(k.any(1), k.argmax(1) + t.start, out))
        return out[:, None]

    head = pairs.map(first)[:, 0].astype(np.int64)
    while (up := head[head]).tobytes() != head.tobytes():
        head = up
    order = np.argsort(head, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(head[order]) != 0])
    by: dict[int, list[np.ndarray]] = {}
    for a, b in zip(begins, np.r_[begins[1:], pairs.n], strict=True):
        for i in range(a, b, most):
            at = order[i : min(b, i + most)]
            by.setdefault(len(at), []).append(at)
    blocks = []
    for size, members in by.items():
        at = np.array(members)
        inv = np.array([np.linalg.inv(tile(pairs.x[m], pairs.x[m]) - c[m] @ c[m].T + np.diag(ridge[m] + 1e-10)) for m in at])
        blocks.append((at, (inv + inv.transpose(0, 2, 1)) / 2))

    def fn(r: np.ndarray) -> np.ndarray:
        out = np.empty_like(r)
        for at, inv in blocks:
            out[at] = inv @ r[at]
        return out

    return fn


def solve(pairs: Pairs, tile: Callable[[np.ndarray, np.ndarray], np.ndarray], ridge: np.ndarray, b: np.ndarray, definite: bool = True, tol: float = 1e-9, rank: int = 1500, max_rounds: int = 2000) -> np.ndarray:
    """(K + diag(ridge)) a = b by conjugate gradients, each round one pass; raises if they don't settle.

    Columns through ``rank`` rows (of at most 160 MB) and blocks of like rows, which are nearly equal lines of the
    equations, precondition a definite kernel; one that isn't takes the squared equations.
    """
    n, want = pairs.n, b.reshape(pairs.n, -1)
    ridge = np.broadcast_to(np.asarray(ridge, float), n)[:, None]

    def times(v):
        return pairs.product(tile, v) + ridge * v

    if definite:
        at = np.sort(np.random.default_rng(0).choice(n, min(rank, max(128, 20_000_000 // n), n), replace=False))
        w = tile(pairs.x[at], pairs.x[at])
        low = np.linalg.inv(np.linalg.cholesky(w + 1e-12 * np.trace(w) * np.eye(len(w))))
        c = np.empty((n, len(at)))
        for t in tiles(n, 512):
            c[t] = tile(pairs.x[t], pairs.x[at]) @ low.T
        rest = _like(pairs, tile, c, ridge[:, 0])
        small = np.linalg.inv(np.eye(len(at)) + c.T @ rest(c))

        def before(r):
            r = rest(r)
            return r - rest(c @ (small @ (c.T @ r)))

        matrix = times
    else:
        before, matrix, want = (lambda r: r), (lambda v: times(times(v))), times(want)
    goal = tol * np.maximum(np.sqrt((want * want).sum(0)), 1e-300)
    a, r = np.zeros_like(want), want.copy()
    z = before(r)
    d, rz = z.copy(), (r * z).sum(0)
    for _ in range(max_rounds):
        if (np.sqrt((r * r).sum(0)) <= goal).all():
            return a.reshape(b.shape)
        q = matrix(d)
        step = rz / np.where(rz == 0, 1.0, (d * q).sum(0))
        a, r = a + step * d, r - step * q
        z = before(r)
        new = (r * z).sum(0)
        d, rz = z + new / np.where(rz == 0, 1.0, rz) * d, new
    raise RuntimeError(f"the kernel's equations did not settle in {max_rounds} rounds; choose a greater ridge")


def top_of(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-9, depth: int = 6, max_rounds: int = 300, more: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their vectors of the symmetric n x n matrix that ``times`` multiplies by.

    Blocks of a Krylov space, begun anew from the best vectors found; raises if they don't settle.
    """
    size = min(n, k + more)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((n, size)))[0]
    basis, images = q, times(q)
    for _ in range(max_rounds):
        v, s = np.linalg.eigh((t := basis.T @ images) / 2 + t.T / 2)
        v, s = v[::-1], s[:, ::-1]
        best = basis @ s[:, :k]
        rest = images @ s[:, :size] - basis @ (s[:, :size] * v[:size])
        if basis.shape[1] == n or np.sqrt((rest[:, :k] ** 2).sum(0)).max() <= tol * np.abs(v).max():
            return v[:k], best
        if basis.shape[1] + size > min(n, depth * size):
            keep = s[:, : min(2 * size, basis.shape[1])]
            basis, images = basis @ keep, images @ keep
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
            rest /= np.maximum(np.sqrt((rest * rest).sum(0)), 1e-300)
        new = np.linalg.qr(rest[:, : n - basis.shape[1]])[0]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        basis, images = np.hstack([basis, new]), np.hstack([images, times(new)])
    raise RuntimeError(f"the eigenvectors did not settle in {max_rounds} rounds")


class Graph:
    """The links of each of n rows to its neighbours ``at``, either way, with the greater of both weights (1 if not given)."""

    def __init__(self, n: int, at: np.ndarray, weight: np.ndarray | None = None):
        i, j = np.repeat(np.arange(n), at.shape[1]), at.ravel()
        w = np.ones(len(i)) if weight is None else weight.ravel()
        keys, where = np.unique(np.concatenate([i * n + j, j * n + i]), return_inverse=True)
        self.n, self.i, self.j, self.w = n, keys // n, keys % n, np.zeros(len(keys))
        np.maximum.at(self.w, where.ravel(), np.concatenate([w, w]))
        self.begins = np.searchsorted(self.i, np.arange(n))  # each row has a neighbour

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v[self.j] * self.w[:, None], self.begins, axis=0)


def bottom_of(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, most: float) -> np.ndarray:
    """The vectors of the k smallest eigenvalues, rising, of a cheap matrix with eigenvalues from 0 to ``most``.

    They are the greatest of a Chebyshev polynomial that is over 1 in the lowest part of that range and at most 1 in the
    rest; the part grows until it holds all k.
    """
    for cut in (2e-3, 1.6e-2, 0.128, 0.6, 0.9):
        low, degree = cut * most, int(4 / np.sqrt(cut)) + 1
        half, mid = (most - low) / 2, (most + low) / 2

        def filtered(v, half=half, mid=mid, degree=degree):
            a, b = v, (mid * v - times(v)) / half
            for _ in range(degree - 1):
                a, b = b, 2 * (mid * b - times(b)) / half - a
            return b

        try:
            v = top_of(filtered, n, k, max_rounds=300 if cut == 0.9 or n > 2000 else 60)[1]
        except RuntimeError:
            if cut == 0.9:
                raise
            continue
        e, s = np.linalg.eigh(v.T @ times(v))
        if e[-1] < low:
            return v @ s
    raise RuntimeError("the smallest eigenvalues are not in the lower part of their range")


def paths(graph: Graph, at: slice) -> np.ndarray:
    """The lengths of the shortest paths from rows ``at`` to all, infinite where there is none; the graph's weights are lengths."""
    out = np.full((graph.n, at.stop - at.start), np.inf)
    out[np.arange(at.start, at.stop), np.arange(at.stop - at.start)] = 0
    degree = np.diff(np.r_[graph.begins, len(graph.i)])
    by = np.argsort(-degree, kind="stable")  # rows by falling degree: those with a further neighbour come first
    steps = [by[: int((degree > k).sum())] for k in range(int(degree.max()))]
    while True:
        new = out.copy()
        for k, rows in enumerate(steps):
            e = graph.begins[rows] + k
            new[rows] = np.minimum(new[rows], out[graph.j[e]] + graph.w[e, None])
        if np.array_equal(new, out):
            return out.T
        out = new


def closed_classes(at: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The sets of rows that all reach each other along the links ``at`` of a weight, and no other row; the largest first, then by first row."""
    n = len(at)
    links = [[j for j, v in zip(a, b, strict=True) if v] for a, b in zip(at.tolist(), w.tolist(), strict=True)]
    number, low, of, stack, count, classes = [-1] * n, [0] * n, [-1] * n, [], 0, []
    for root in range(n):
        if number[root] >= 0:
            continue
        path = [(root, 0)]
        while path:
            i, k = path.pop()
            if k == 0:
                number[i] = low[i] = count
                count += 1
                stack.append(i)
            while k < len(links[i]):
                j = links[i][k]
                k += 1
                if number[j] < 0:
                    path += [(i, k), (j, 0)]
                    break
                if of[j] < 0:
                    low[i] = min(low[i], number[j])
            else:
                if low[i] == number[i]:
                    members = []
                    while not members or members[-1] != i:
                        members.append(stack.pop())
                        of[members[-1]] = len(classes)
                    classes.append(sorted(members))
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[i])
    closed = [c for k, c in enumerate(classes) if all(of[j] == k for i in c for j in links[i])]
    return [np.array(c) for c in sorted(closed, key=lambda c: (-len(c), c[0]))]


def least_squares(times: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, b: np.ndarray, tol: float = 1e-10, max_rounds: int = 200_000) -> np.ndarray:
    """A v = b by conjugate gradients on A'A, whose diagonal is given; raises if they don't settle."""
    v, r, inv = np.zeros_like(b), b.copy(), 1 / diagonal[:, None]
    g = back(r)
    z = inv * g
    d, gz = z, (g * z).sum(0)
    goal = tol * np.maximum(np.sqrt((b * b).sum(0)), 1e-300)
    for _ in range(max_rounds):
        if (np.sqrt((r * r).sum(0)) <= goal).all():
            return v
        q = times(d)
        step = gz / np.maximum((q * q).sum(0), 1e-300)
        v, r = v + step * d, r - step * q
        g = back(r)
        z = inv * g
        new = (g * z).sum(0)
        d, gz = z + new / np.maximum(gz, 1e-300) * d, new
    raise RuntimeError(f"the equations did not settle in {max_rounds} rounds")


class Far:
    """The squared lengths of all shortest paths; rows that no path joins are ``far`` times the longest apart.

    Kept on the executors' disks if they take at most ``most`` bytes, else made anew for each product.
    """

    def __init__(self, spark: SparkSession, graph: Graph, far: float = 10.0, most: float = 2e9):
        self.n, self.sc = graph.n, spark.sparkContext
        rows = max(1, min(64, 2_000_000 // self.n))
        self.graph = sent = self.sc.broadcast(graph)

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    d = paths(sent.value, slice(i * rows, min(sent.value.n, (i + 1) * rows)))
                    yield pa.RecordBatch.from_arrays([pa.array([i * rows], pa.int64()), pa.array([np.ascontiguousarray(d).tobytes()], pa.binary()), pa.array([float(d[np.isfinite(d)].max())])], names=["i", "v", "top"])

        blocks = -(-self.n // rows)
        self.kept = spark.range(0, blocks, 1, blocks).mapInArrow(lengths, "i long, v binary, top double")
        if self.n * self.n * 8 <= most:
            self.kept = self.kept.persist(StorageLevel.DISK_ONLY)
        self.apart = far * self.kept.agg({"top": "max"}).first()[0]

    def product(self, v: np.ndarray) -> np.ndarray:
        sent, n, apart = self.sc.broadcast(v), self.n, self.apart

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for b in batches:
                for i, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    d = np.frombuffer(d.as_buffer(), float).reshape(-1, n)
                    d = np.where(np.isfinite(d), d, apart)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([((d * d) @ sent.value).tobytes()], pa.binary())], names=["i", "v"])

        got = self.kept.select("i", "v").mapInArrow(run, "i long, v binary").toArrow().sort_by("i")
        sent.destroy()
        return np.concatenate([np.frombuffer(x.as_buffer(), float) for x in got["v"]]).reshape(v.shape)

    def close(self) -> None:
        self.kept.unpersist()
        self.graph.destroy()
