"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids with an end id; only those longer than a sequence are cut. Pieces that fill a sequence alone
are done. The others are dealt by a hash of a row number into shards of about ``shard_items`` pieces, and each shard is
evolved on several islands: a chromosome is a partition of the shard's pieces into bins, crossover injects well-filled
bins of one parent into the other, drops the bins that hold duplicates and best-fits what was displaced. After each epoch
every island receives its neighbour's elite. Fewer bins are better, and of as many bins those filled more unequally, so
that a shard's free space gathers in the bin that it passes on. Every island runs ``MIN_GENERATIONS`` generations an epoch
and every shard ``MIN_EPOCHS`` epochs, so its elites migrate at least once; after that an island stops when it reaches the
shard's lower bound, the tokens over the capacity. What the emptiest bin of each shard holds goes to the next level's shards, so that the waste at shard edges
is packed again, until one shard is left. A level has no more shards than its tokens fill with ``SHARD_BINS`` bins each:
short pieces share a shard of more than ``shard_items`` then, and a level passes on an eighth of its tokens at most.

Shards and chromosomes have a bounded size whatever the corpus; nothing is collected to the driver but row counts.

Defined results: a null or empty text is the end id alone; rows that repeat are packed each; an empty table gives an
empty result; other columns of the input are not read. A null id stays null.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.shingles import texts_of
from tessera.llm.wordcodec import by_bytes, splits_at_space, worker_tokenizer

CAPACITY = 4096
SHARD_ITEMS = 4096
#: Bins of a shard, in tokens, from which a level has more than one shard. A shard of one bin would only pass it on.
SHARD_BINS = 16
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 12
POPULATION = 6
#: Beyond these an island ends as soon as it has no more bins than its tokens need.
MIN_GENERATIONS, MIN_EPOCHS = 2, 2
#: A bin this full is worth injecting whole.
WELL_FILLED = 0.98


# -- packing of one shard ---------------------------------------------------------------------------------------------
Bins = list[list[int]]


class _Open:
    """Bins by free space; the least space that suffices is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.bits = capacity, 0
        self.by_space: dict[int, list[int]] = {}

    def put(self, b: int, space: int) -> None:
        if space:
            self.by_space.setdefault(space, []).append(b)
            self.bits |= 1 << space

    def take(self, need: int) -> tuple[int, int] | None:
        rest = self.bits >> need
        if not rest:
            return None
        space = need + (rest & -rest).bit_length() - 1
        held = self.by_space[space]
        b = held.pop()
        if not held:
            self.bits ^= 1 << space
            del self.by_space[space]
        return b, space


def best_fit(items: list[int], size: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Puts ``items`` in the given order each into the fullest bin that has room, after those in ``bins``."""
    bins = [list(b) for b in bins or []]
    spaces = _Open(capacity)
    for k, b in enumerate(bins):
        spaces.put(k, capacity - sum(size[i] for i in b))
    for i in items:
        found = spaces.take(size[i])
        if found is None:
            bins.append([i])
            spaces.put(len(bins) - 1, capacity - size[i])
        else:
            bins[found[0]].append(i)
            spaces.put(found[0], found[1] - size[i])
    return bins


def lower_bound(size: list[int], capacity: int) -> int:
    return -(-sum(size) // capacity)


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins as unequally filled as possible."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Injects a random half of ``b``'s well-filled bins into ``a``; what that displaces is best-fitted, longest first."""
    full = [x for x in b if sum(size[i] for i in x) >= WELL_FILLED * capacity]
    if not full:
        full = sorted(b, key=lambda x: -sum(size[i] for i in x))[: max(1, len(b) // 2)]
    given = rng.sample(full, max(1, len(full) // 2))
    taken = {i for x in given for i in x}
    left = [x for x in a if taken.isdisjoint(x)]
    displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
    return best_fit(sorted(displaced, key=lambda i: -size[i]), size, capacity, given + left)


def mutate(a: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Empties the least filled bins and a few others, and best-fits their items in a slightly shuffled order."""
    order = sorted(a, key=lambda x: sum(size[i] for i in x))
    n = max(1, len(a) // 20)
    gone = order[:n] + rng.sample(order[n:], min(n, len(order) - n))
    ids = {id(x) for x in gone}
    loose = sorted((i for x in gone for i in x), key=lambda i: -size[i] * rng.uniform(0.8, 1.25))
    return best_fit(loose, size, capacity, [x for x in a if id(x) not in ids])


def evolve(size: list[int], capacity: int, generations: int, population: int, seed: int, elites: list[Bins] = ()) -> tuple[Bins, int]:
    """The best of one island after ``generations``, and how often it crossed; ``elites`` join the first population."""
    rng, bound, crossed = random.Random(seed), lower_bound(size, capacity), 0
    down = sorted(range(len(size)), key=lambda i: -size[i])
    pool: list[Bins] = [list(e) for e in elites] or [best_fit(down, size, capacity)]
    score = lambda x: fitness(x, size, capacity)
    while len(pool) < population:
        pool.append(best_fit(sorted(down, key=lambda i: -size[i] * rng.uniform(0.7, 1.4)), size, capacity))
    ranked = sorted(((score(x), k, x) for k, x in enumerate(pool)), key=lambda x: x[:2])
    for g in range(generations):
        if g >= MIN_GENERATIONS and len(ranked[0][2]) <= bound:
            break
        parents = ranked[: max(2, population // 2)]
        young = [crossover(*(x[2] for x in rng.sample(parents, 2)), size, capacity, rng) for _ in range(max(1, population - len(parents) - 1))]
        crossed += len(young)
        young.append(mutate(ranked[0][2], size, capacity, rng))
        ranked = sorted([*parents, *((score(x), (g + 1) * population + k, x) for k, x in enumerate(young))], key=lambda x: x[:2])
    return ranked[0][2], crossed


def _flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(flat: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return out


# -- the pieces -------------------------------------------------------------------------------------------------------
def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every document's pieces of at most ``capacity`` tokens."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    dtype = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            row, piece, length, crc = [], [], [], []
            for k, ids in enumerate(encode(texts_of(batch, 1))):
                ids += end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(k)
                    piece.append(p)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
            piece = pa.array(piece, pa.int32())
            start = pa.array(np.asarray(piece, np.int64) * capacity, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), piece, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, f"doc_id {dtype}, piece int, start long, length long, ids_crc32 long")


def _encoder(path: str):
    words = worker_tokenizer(path)
    if splits_at_space(path):
        return words.encode
    return lambda texts: (np.array(e.ids, "<u4").tobytes() for part in by_bytes(texts) for e in words.library.encode_batch_fast(part, add_special_tokens=False))


# -- the islands ------------------------------------------------------------------------------------------------------
_STATE = "shard long, island int, uids array<long>, size array<int>, flat array<int>, n_bins int, bound int, loose double, crossed int, migrated int"


def _epoch(state: DataFrame, capacity: int, generations: int, population: int, seed: int, names: tuple[str, ...]) -> DataFrame:
    """One epoch of every island; ``names`` are the columns that may hold a chromosome to begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, bound = row["size"], lower_bound(row["size"], capacity)
                elites = [_bins(row[c]) for c in names if row.get(c)]
                best, crossed = evolve(size, capacity, generations, population, hash((seed, row["shard"], row["island"])), elites)
                came = int(row.get("elite") is not None)
                out = {"shard": row["shard"], "island": row["island"], "uids": row["uids"], "size": size, "flat": _flat(best, len(size)), "n_bins": len(best), "bound": bound, "loose": fitness(best, size, capacity)[1], "crossed": (row.get("crossed") or 0) + crossed, "migrated": (row.get("migrated") or 0) + came}
                yield pa.RecordBatch.from_pylist([out], schema=_schema())

    return state.mapInArrow(run, _STATE)


def _schema() -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("flat", pa.list_(pa.int32())), ("n_bins", pa.int32()), ("bound", pa.int32()), ("loose", pa.float64()), ("crossed", pa.int32()), ("migrated", pa.int32())])


def _pack_level(items: DataFrame, n_shards: int, scratch: Scratch, *, capacity: int, islands: int, epochs: int, generations: int, population: int, level: int, report: list[DataFrame] | None = None) -> DataFrame:
    """(shard, bin, uids, size, space) for the bins of the best island of each shard; ``report`` gets a table of what its islands did."""
    first = (
        items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_shards)))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_list(F.struct("length", "uid"))).alias("items"))
        .select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.uid").alias("uids"), F.transform("items.length", lambda x: x.cast("int")).alias("size"))
        .repartition(max(1, min(n_shards * islands, 4 * items.sparkSession.sparkContext.defaultParallelism)), "shard", "island")
    )
    state = scratch.save(_epoch(first, capacity, generations, population, level, ()), f"islands{level}")
    for epoch in range(1, epochs):
        # all exchange elites at first, then the shards that are over their bound
        over = state.groupBy("shard").agg(F.min(F.col("n_bins") - F.col("bound")).alias("over"))
        short = (over if epoch < MIN_EPOCHS else over.filter("over > 0")).select(F.col("shard").alias("s"))
        if epoch >= MIN_EPOCHS and short.isEmpty():
            break
        open_ = state.join(short, F.col("shard") == F.col("s"), "left_semi")
        came = open_.select(F.col("shard").alias("s"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("to"), F.col("flat").alias("elite"))
        mixed = open_.join(came, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("to"))).drop("s", "to")
        nxt = _epoch(mixed, capacity, generations, population, level + 1000 * epoch, ("flat", "elite"))
        old = state
        state = scratch.save(nxt.unionByName(state.join(short, F.col("shard") == F.col("s"), "left_anti")), f"islands{level}")
        scratch.drop(old)
    if report is not None:
        report.append(scratch.save(state.select(F.lit(level).alias("level"), "shard", "island", F.size("uids").alias("items"), "n_bins", "bound", "loose", "crossed", "migrated"), f"report{level}"))
    best = state.groupBy("shard").agg(F.min_by(F.struct("uids", "size", "flat"), F.struct("n_bins", "loose", "island")).alias("b"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = row["b"]
                out = [{"shard": row["shard"], "bin": k, "uids": [b["uids"][i] for i in x], "size": [b["size"][i] for i in x], "space": capacity - sum(b["size"][i] for i in x)} for k, x in enumerate(_bins(b["flat"]))]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("bin", pa.int64()), ("uids", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("space", pa.int32())]))

    out = scratch.save(best.mapInArrow(bins, "shard long, bin long, uids array<long>, size array<int>, space int"), f"bins{level}")
    scratch.drop(state)
    return out


def count_and_tokens(items: DataFrame) -> tuple[int, int]:
    return tuple(items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())


def pack_items(items: DataFrame, n_items: int, n_tokens: int, scratch: Scratch, *, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, report: list[DataFrame] | None = None) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid long, unique; length int, from 1 to ``capacity``), of which there are ``n_items`` with ``n_tokens`` tokens."""
    opts = {"capacity": capacity, "islands": islands, "epochs": epochs, "generations": generations, "population": population, "report": report}
    placed: list[DataFrame] = []
    level, n, tokens = 0, n_items, n_tokens
    while n:
        # n_shards > 1 means tokens > SHARD_BINS * capacity, and a shard passes on one bin: tokens / 16 + capacity at most
        n_shards = min(-(-n // shard_items), -(-tokens // (SHARD_BINS * capacity)))
        bins = _pack_level(items, n_shards, scratch, level=level, **opts)
        final = bins
        if n_shards > 1:
            tail = bins.groupBy("shard").agg(F.max_by("bin", F.struct("space", "bin")).alias("t"), F.max("space").alias("most")).filter("most > 0").select(F.col("shard").alias("s"), "t")
            on = (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("t"))
            final = bins.join(tail, on, "left_anti")
            items = bins.join(tail, on, "left_semi").select(F.explode(F.arrays_zip("uids", "size")).alias("x")).select(F.col("x.uids").alias("uid"), F.col("x.size").alias("length"))
            n, tokens = count_and_tokens(items)
        else:
            n = 0
        placed.append(final.select((-(F.lit(level) * (1 << 52) + F.col("shard") * (1 << 16) + F.col("bin")) - 1).alias("sequence_id"), "uids", "size"))
        level += 1
    if not placed:
        return items.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    ends: Column = F.expr("transform(size, (s, i) -> cast(aggregate(slice(size, 1, i), 0, (a, b) -> a + b) as long))")
    return every.withColumn("at", ends).select("sequence_id", F.explode(F.arrays_zip("uids", "at")).alias("x")).select(F.col("x.uids").alias("uid"), "sequence_id", F.col("x.at").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.save(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = cut.filter(F.col("length") < capacity)
    seats = pack_items(loose.select("uid", F.col("length").cast("int").alias("length")), *count_and_tokens(loose), scratch, capacity=capacity, **options)
    whole = cut.filter(F.col("length") >= capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(loose.join(seats, "uid")).drop("uid")
