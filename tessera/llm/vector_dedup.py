"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code is the sign pattern of its randomly rotated direction; with it goes a correction factor, the inner product
of the rotated direction and its code. For any other direction q, <code, q> / factor is an unbiased estimate of the cosine,
with a confidence bound from the factor. The other vector is itself in whole numbers of ``QUERY_BITS`` bits a coordinate,
rounded at random so that the estimate stays unbiased, and inner products are counts of common bits. Pairs whose upper
bound is under the threshold are done; the cosine of the others is recomputed from the vectors in double precision, so no
link is below the threshold.

Candidate pairs share a bucket: several of the signs of one of many rotations. The number of signs follows the logarithm
of the number of vectors, and that of the buckets a vector is in follows from ``MISS``, the probability that a pair at
the threshold shares none. Equal vectors are one class. Buckets are split into blocks of ``BLOCK`` vectors and the pairs
of blocks into tasks. There are two passes: in the first only codes meet, and a task returns which of its vectors have a
pair that may be linked; in the second these vectors meet again with their components. A pair counts in the first of its
common buckets. A task returns a row per linked vector, the number of its links and the root of a spanning forest, never
a row per pair.

Vectors are scaled by a power of two before anything else, so very small and very large components count as they should.

Defined results: a vector that is null, empty or zero, or holds nulls or non-finite numbers, links with nothing; vectors
of different lengths never link; rows that repeat a vec_id are one vector for components and count as one link each;
a null vec_id links with nothing, has a null component and is kept; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch, partitions
from tessera.llm.shingles import Forest, U, mix, run_batches
from tessera.llm.skew import join_one

THRESHOLD = 0.95
MISS = 1e-6
BLOCK = 512
#: Standard errors that the confidence bound holds.
EPSILON = 5.0
SEED = 20
QUERY_BITS = 4


@functools.lru_cache(maxsize=64)
def rotation(dim: int, k: int, seed: int = SEED) -> np.ndarray:
    """The k-th random orthogonal matrix of this size."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs in a bucket's key, and buckets a vector is in."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, n) / 64))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


@dataclass
class Codes:
    """Of some vectors: sign codes and factors, and the rotated directions as ``low + step * whole number``, in planes of bits."""

    dim: int
    code: np.ndarray  # vectors x words
    planes: np.ndarray  # vectors x QUERY_BITS x words
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray  # sum of the whole numbers

    @classmethod
    def of(cls, directions: np.ndarray, ids: np.ndarray) -> Codes:
        dim = directions.shape[1]
        turned = directions @ rotation(dim, 0).T
        low, top = turned.min(1), turned.max(1)
        step = (top - low) / ((1 << QUERY_BITS) - 1)
        # the same rounding wherever a vector is encoded
        draw = (mix(ids.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(dim, dtype=U)) >> U(11)) * 2.0**-53
        whole = np.floor((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None] + draw).clip(0, (1 << QUERY_BITS) - 1).astype(np.uint8)
        planes = np.stack([_words(whole >> k & 1) for k in range(QUERY_BITS)], 1)
        return cls(dim, _words(turned >= 0), planes, np.abs(turned).sum(1) / math.sqrt(dim), low, step, whole.sum(1, dtype=np.int64))

    def rows(self) -> list[pa.Array]:
        """Columns ``FIELDS``."""
        blob = [np.concatenate([c, p.ravel()]).tobytes() for c, p in zip(self.code, self.planes, strict=True)]
        return [pa.array(blob, pa.binary()), pa.array(np.stack([self.factor, self.low, self.step, self.total], 1).tolist(), pa.list_(pa.float64()))]

    FIELDS = "code binary, code_of array<double>"

    @classmethod
    def from_rows(cls, dim: int, code: pa.Array, code_of: pa.Array) -> Codes:
        words = -(-dim // 64)
        m = np.frombuffer(b"".join(code.to_pylist()), np.uint64).reshape(len(code), 1 + QUERY_BITS, words)
        of = code_of.flatten().to_numpy().reshape(len(code), 4)
        return cls(dim, m[:, 0], m[:, 1:], of[:, 0], of[:, 1], of[:, 2], of[:, 3])

    def __getitem__(self, at: slice) -> Codes:
        return Codes(self.dim, self.code[at], self.planes[at], self.factor[at], self.low[at], self.step[at], self.total[at])

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unbiased estimates of the cosines of these vectors, by their whole numbers, with the ``other`` ones, by their codes.

        Their variance is (1 - cosine ** 2) times the second result, of what the other's code leaves of its direction among
        dim - 1 degrees of freedom, and at most the third, of rounding by at most half a step on average.
        """
        common = np.zeros((len(self.low), len(other.factor)), np.int64)
        for w in range(self.code.shape[1]):
            for k in range(QUERY_BITS):
                common += np.bitwise_count(self.planes[:, k, w][:, None] & other.code[:, w][None, :]).astype(np.int64) << k
        ones = np.bitwise_count(other.code).sum(1, dtype=np.int64)
        inner = self.low[:, None] * (2 * ones - self.dim)[None, :] + self.step[:, None] * (2 * common - self.total[:, None])
        f2 = other.factor**2
        return inner / math.sqrt(self.dim) / other.factor[None, :], np.maximum(1 - f2, 0) / f2 / max(1, self.dim - 1), (self.step**2 / 4)[:, None] / f2[None, :]

    def likely(self, other: Codes | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of the pairs that may be linked; of these vectors among themselves (i < j) without ``other``.

        Of all cosines from the threshold on, the threshold itself has the smallest lower bound for its estimate.
        """
        estimate, left, rounding = self.estimates(self if other is None else other)
        found = estimate + EPSILON * np.sqrt((1 - threshold**2) * left[None, :] + rounding) >= threshold
        return np.nonzero(np.triu(found, 1) if other is None else found)


def bucket_keys(directions: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """vectors x bands: the signs of ``bits`` coordinates of a rotation as a number."""
    dim = directions.shape[1]
    out = np.zeros((len(directions), bands), np.int64)
    signs: dict[int, np.ndarray] = {}
    for b in range(bands):
        for j in range(b * bits, (b + 1) * bits):
            k = 1 + j // dim
            if k not in signs:
                signs = {k: directions @ rotation(dim, k).T >= 0, k - 1: signs.get(k - 1)}
            out[:, b] = out[:, b] * 2 + signs[k][:, j % dim]
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its greatest component near one: sums of squares stay finite, cosines the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _directions(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def linked(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of rows of ``x`` have a cosine of at least the threshold, in double precision."""
    x = scaled(x)
    squares, exact = (x * x).sum(1), np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        exact[at : at + (1 << 16)] = (x[a] * x[b]).sum(1) / np.sqrt(squares[a] * squares[b])
    return exact >= threshold


def _classes(vectors: DataFrame) -> DataFrame:
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.filter(ok & F.col("vec_id").isNotNull()).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})


def vector_dedup(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``table``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    classes = scratch.save(_classes(vectors).groupBy("h", "g").agg(F.min(F.struct("vec_id", "v")).alias("m"), F.count("*").alias("copies")).select("h", "g", F.col("m.vec_id").alias("rep"), F.col("m.v").alias("v"), "copies"), "classes")
    bits, bands = plan(classes.count(), threshold)
    coded = scratch.save(_coded(classes, bits, bands), "codes")
    tasks = scratch.save(_tasks(coded, threshold), "likely")
    found = scratch.save(_linked(tasks, coded, classes, threshold), "links")
    n = found.groupBy(F.col("rep").alias("r")).agg(F.sum("n").alias("n"))
    each = classes.join(n, F.col("rep") == F.col("r"), "left").select("h", "g", "rep", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    counted = scratch.save(join_one(_classes(vectors).select("vec_id", "h", "g"), each, ["h", "g"], ["rep", "n_links"], "copies", F.col("vec_id")).select("vec_id", "rep", "n_links"), "counted")
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(counted.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges, scratch)
    ids = table.select(F.col(id_col).cast("long").alias("vec_id"))
    per_id = counted.groupBy(F.col("vec_id").alias("i")).agg(F.max("n_links").alias("n_links"))
    out = ids.join(per_id, F.col("vec_id") == F.col("i"), "left").join(labels, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop(classes, coded, tasks, found, counted)
    return out


def _coded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """Each class with its code and bucket keys, without its components."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                d = _directions(part.column(1).flatten().to_numpy().reshape(-1, dim))
                keys = bucket_keys(d, bits, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                codes = Codes.of(d, part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([dim] * len(d), pa.int32()), *codes.rows(), lists], names=["rep", "dim", "code", "code_of", "keys"])

    return classes.select("rep", "v").mapInArrow(code, f"rep long, dim int, {Codes.FIELDS}, keys array<long>")


_BUCKET = ["dim", "band", "key"]
_ORDER = [*_BUCKET, "i", "j"]


def _tasks(coded: DataFrame, threshold: float) -> DataFrame:
    """(dim, band, key, i, j, side, rep) of the vectors that may have a link in a task, which is a pair of blocks of a bucket."""
    rows = coded.select("dim", F.posexplode("keys").alias("band", "key"), "rep")
    sizes = rows.groupBy(*_BUCKET).agg(F.count("*").alias("c")).filter("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    seats = join_one(rows, sizes, _BUCKET, ["blocks"], "c", F.col("rep")).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    seats = seats.select(*_BUCKET, "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    seats = seats.select(*_BUCKET, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep")
    full = seats.join(coded.select("rep", "code", "code_of"), "rep").select(*_ORDER, "side", "rep", "code", "code_of")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_, i, j), rows in run_batches(batches, 5):
            n = _split(rows, i == j)
            if n:
                a, b = _likely(dim, rows, n, threshold)
                at = pa.array(np.union1d(a, b))
                if len(at):
                    yield from rows.select([*_ORDER, "side", "rep"]).take(at).combine_chunks().to_batches()

    return _dealt(full).mapInArrow(meet, "dim int, band int, key long, i int, j int, side int, rep long")


def _linked(tasks: DataFrame, coded: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, root) of the linked vectors of each task."""
    full = tasks.join(coded.select("rep", "code", "code_of", "keys"), "rep").join(classes.select("rep", "v", "copies"), "rep")
    full = full.select(*_ORDER, "side", "rep", "v", "copies", "code", "code_of", F.slice("keys", 1, F.col("band")).alias("before"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_, i, j), rows in run_batches(batches, 5):
            n = _split(rows, i == j)
            out = _task(dim, rows, n, threshold) if n else None
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "n", "root"])

    return _dealt(full).mapInArrow(link, "rep long, n long, root long")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER, "side", "rep")


def _split(rows: pa.Table, alone: bool) -> int:
    """Where the second block begins, or the end of the only one; 0 if there are no pairs."""
    m = rows.num_rows
    n = m if alone else int(np.searchsorted(rows["side"].to_numpy(), 1))
    return 0 if m < 2 or (not alone and n in (0, m)) else n


def _likely(dim: int, rows: pa.Table, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    codes = Codes.from_rows(dim, rows["code"].combine_chunks(), rows["code_of"].combine_chunks())
    if n == rows.num_rows:
        return codes.likely(None, threshold)
    a, b = codes[:n].likely(codes[n:], threshold)
    return a, b + n


def _task(dim: int, rows: pa.Table, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The linked vectors of a task: their ids, numbers of links, and roots."""
    m = rows.num_rows
    rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    x = rows["v"].combine_chunks().flatten().to_numpy().reshape(m, dim)
    keys = rows["before"].combine_chunks().flatten().to_numpy().reshape(m, -1)
    a, b = _likely(dim, rows, n, threshold)
    ok = linked(x, a, b, threshold)
    a, b = a[ok], b[ok]
    first = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        first[s] = ~(keys[a[s]] == keys[b[s]]).any(1)
    a, b = a[first], b[first]
    if not len(a):
        return None
    counts = np.bincount(a, copies[b], m).astype(np.int64) + np.bincount(b, copies[a], m).astype(np.int64)
    forest = Forest(m)
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        forest.join(p, q)
    linked_ = np.flatnonzero(counts)
    return rep[linked_], counts[linked_], rep[[forest.root(k) for k in linked_.tolist()]]
