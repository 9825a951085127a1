"""MinHash near-dedup by min-max hashing.

Texts with equal shingle sets are one class. Each class has a signature of the least and the greatest value under every
permutation, so that one hash evaluation gives two of its values; bands of it name buckets. Buckets never become pairs:

1. Each member meets its bucket's smallest member, in blocks of bounded size that all other members dealt to the block
   meet too. Every link is decided by the full sets.
2. Buckets that still hold more than one component are contested. Their members outside the component of the smallest
   one are queries, in blocks, against all members in blocks. After that every pair that shares a bucket has been
   decided, or is joined already.
3. A contested bucket of more than ``REFINE`` members isn't compared in blocks, whose number is the square of its size:
   its members are dealt into buckets of ``FINE_BANDS`` longer bands first, in which texts that share little more than
   what brought them together no longer meet, and those go through 1 and 2. A pair at the threshold shares none of these
   with probability 1e-6.

Rows of a hot bucket are dealt out wherever they meet its leader or its number of blocks.

A block has at most ``BLOCK`` texts or about ``BLOCK_SHINGLES`` shingles (a single longer text is a block's only), so a
group that holds a third of all rows is many tasks, and a block emits a spanning forest of its links, never all pairs.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing; rows that repeat a
doc_id are one document, with the links of all its texts; a null doc_id links with nothing, has a null component and is
kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch, partitions
from tessera.llm.shingles import U, Forest, Index, band_keys, chunks, links_within, min_max_signature, mix, runs, shingle_hashes, texts_of
from tessera.llm.skew import join_one

#: A pair at similarity 0.8 shares none of 40 bands of 6 values with probability 5e-6.
BANDS, ROWS = 40, 6
BLOCK, BLOCK_SHINGLES = 256, 500_000
REFINE, FINE_BANDS, FINE_ROWS = 8192, 122, 10


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (shingles), digest of the set, bands (keys; null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(texts_of(batch, 1)):
                hashes, begins = shingle_hashes(texts, width)
                sets = [np.unique(hashes[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]
                some = np.flatnonzero(np.diff(begins) > 0)
                keys = np.zeros((len(texts), bands), U)
                if len(some):
                    keys[some] = band_keys(min_max_signature(hashes, np.append(begins[some], len(hashes)), bands * rows // 2), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * bands, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), lists], names=["doc_id", "n", "digest", "bands"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, "doc_id long, n long, digest binary, bands array<long>")


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, set) for the texts whose document and digest are in ``wanted`` (rep, digest)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(texts_of(batch, 2)):
                hashes, begins = shingle_hashes(texts, width)
                ids, want = batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)).to_pylist()
                sets = [np.unique(hashes[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]
                keep = pa.array([_digest(s) == w for s, w in zip(sets, want, strict=True)])
                yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep)], names=["doc", "set"])
                at += len(texts)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("doc_id", "digest", "text").mapInArrow(shingle, "doc long, set binary")


def _array(b: bytes) -> np.ndarray:
    return np.frombuffer(b, U)


def _n_blocks(n: F.Column, shingles: F.Column) -> F.Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _links_to_leaders(members: DataFrame, sets: DataFrame, min_pct: int) -> DataFrame:
    led = members.filter("rep <> leader").select("leader", "rep", "n").distinct()
    n = led.groupBy("leader").agg(F.count("*").alias("c"), _n_blocks(F.count("*"), F.sum(F.col("n").cast("long"))).alias("blocks"))
    dealt = join_one(led, n, ["leader"], ["blocks"], "c", F.col("rep")).select("leader", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.col("rep").alias("doc"))
    dealt = dealt.unionByName(n.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("doc")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, sets_) in runs(batches, 2):
            if len(ids) > 1:
                yield _edges(links_within(ids, [_array(s) for s in sets_], min_pct))

    size = max(partitions(sets.sparkSession), 1)
    return dealt.join(sets, "doc").select("leader", "block", "doc", "set").repartition(size, "leader", "block").sortWithinPartitions("leader", "block").mapInArrow(link, "a long, b long")


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _contested(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with ``comp``, the smallest one ``base`` and the bucket's size ``c``; buckets with the same members count once."""
    known = members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    many = known.groupBy("key").agg(F.min("comp").alias("base"), F.max("comp").alias("top"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).filter("base < top")
    once = many.groupBy("c", "who", "base").agg(F.min("key").alias("key"))
    return join_one(known, once, ["key"], ["base", "c"], "c", F.col("rep"))


def _links_contested(rows: DataFrame, sets: DataFrame, min_pct: int) -> DataFrame:
    keys, asks, n = ["key"], F.col("comp") != F.col("base"), F.col("n").cast("long")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("w"), _n_blocks(F.count("*"), F.sum(n)).alias("alls"), _n_blocks(F.sum(asks.cast("long")), F.sum(F.when(asks, n).otherwise(F.lit(0)))).alias("asks"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("rep"), c).cast("int")
    sized = join_one(rows, sizes, keys, ["alls", "asks"], "w", F.col("rep"))
    a = sized.filter(asks).select(*keys, block("asks").alias("i"), spread("alls").alias("j"), F.lit(0).alias("side"), F.col("rep").alias("doc"), "comp")
    b = sized.select(*keys, spread("asks").alias("i"), block("alls").alias("j"), F.lit(1).alias("side"), F.col("rep").alias("doc"), "comp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, ids, comp, sets_) in runs(batches, 3):
            forest = Forest(len(ids), comp)
            n = side.index(1) if 1 in side else len(side)
            index = Index([_array(s) for s in sets_[n:]])
            out = []
            for i in range(n):
                out += [(ids[i], ids[n + j]) for j in index.linked(_array(sets_[i]), min_pct).tolist() if forest.join(i, n + j)]
            yield _edges(out)

    size = max(partitions(sets.sparkSession), 1)
    order = [*keys, "i", "j"]
    return a.unionByName(b).join(sets, "doc").select(*order, "side", "doc", "comp", "set").repartition(size, *order).sortWithinPartitions(*order, "side").mapInArrow(link, "a long, b long")


def _finer(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n, key): the buckets of longer bands within each bucket of ``rows``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [_array(s) for s in part.column(1).to_pylist()]
                begins = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                # other permutations than those of the first bands
                keys = band_keys(min_max_signature(mix(np.concatenate(found) ^ U(0xA5A5A5A5A5A5A5A5)), begins, FINE_BANDS * FINE_ROWS // 2), FINE_BANDS, FINE_ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(found) + 1) * FINE_BANDS, FINE_BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc", "fine"])

    fine = sets.join(rows.select("rep").distinct(), F.col("doc") == F.col("rep"), "left_semi").select("doc", "set").mapInArrow(sign, "doc long, fine array<long>")
    return rows.join(fine, F.col("rep") == F.col("doc")).select("rep", "n", "key", F.explode("fine").alias("f")).select("rep", "n", F.xxhash64("key", "f").alias("key"))


def _links(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], scratch: Scratch, min_pct: int, refine: bool = True) -> list[DataFrame]:
    """Tables of edges that join what chains of links connect, from the buckets (rep, n, key); ``sets`` gets (rep) and gives (doc, set)."""
    shared = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    # one row a shared bucket, hashed by partition: the rows themselves need no sort
    members = scratch.save(join_one(rows, shared, ["key"], ["leader"], "c", F.col("rep"), "shuffle_hash"), "buckets")
    held = sets(members.select("rep").distinct())
    edges = [scratch.save(_links_to_leaders(members, held, min_pct), "links")]
    contested = scratch.save(_contested(members, components(edges[0], scratch)), "contested")
    scratch.drop(members)
    if not contested.isEmpty():
        large = contested.filter(F.col("c") > REFINE)
        if refine and not large.isEmpty():
            edges.append(scratch.save(_links_contested(contested.filter(F.col("c") <= REFINE), held, min_pct), "links"))
            edges += _links(scratch.save(_finer(large.select("rep", "n", "key"), held), "finer"), lambda _: held, scratch, min_pct, False)
        else:
            edges.append(scratch.save(_links_contested(contested, held, min_pct), "links"))
    return edges


def near_dedup(docs: DataFrame, width: int = 5, min_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = scratch.save(signatures(docs, width, id_col, text_col), "signatures")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands")).alias("m"), F.count("*").alias("c"))
    reps = scratch.save(classes.select("digest", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands"), "c"), "classes")

    def sets(wanted: DataFrame) -> DataFrame:
        return scratch.save(_sets(docs, wanted.join(reps.select("rep", "digest"), "rep"), width, id_col, text_col), "sets")

    edges = _links(reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key")), sets, scratch, min_pct)
    every = join_one(signed.filter("n > 0 and doc_id is not null").select("doc_id", "digest"), reps, ["digest"], ["rep"], "c", F.col("doc_id")).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    for found in edges:
        every = every.unionByName(found)
    final = components(every, scratch)
    out = signed.join(final, signed["doc_id"] == final["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop(signed, reps, *edges)
    return out
