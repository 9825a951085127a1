"""Line dedup with sharded cuckoo filters over exact reference tables.

The state of a ``LineIndex`` is four tables, each a few segments of rows that are never rewritten:

* references (doc_id, key): which documents hold a line. Exact, and what makes deletions reversible.
* documents that were inserted, and those that were deleted. A reference is live if its document wasn't deleted since.
* counts (key, n, keeper): in how many documents a line is, and the smallest of them. Exact; the latest row of a key holds.
* filters (shard, filter): a cuckoo filter of the keys that at least two documents hold; the latest of a shard holds.

Most lines are in one document. The shard's filter, which never misses a shared key, tells them apart where the
references are, so only lines that may be shared go on to the join with the exact counts that decides. ``insert`` adds
documents and inserts the keys that became shared into the filters; ``delete`` takes documents out again and deletes the
keys that are no longer shared. The result after any inserts and deletes is that of the documents that remain.

Both write what they add: references and counts of the keys they touch, and the filters of the shards of keys that became
shared or ceased to be. A filter that would be more than ``CuckooFilter.FULL`` full is built anew from the exact counts,
twice as large; the number of shards doubles when they hold more than ``shard_keys`` keys each. A segment at least half as
large as the one before is merged with it, so that a row is rewritten as often as the logarithm of the inserts.

A line's key is 128 bits of a hash of its bytes after stripping ASCII white space and lower-casing A-Z; lines of fewer
than ``min_chars`` code points have none. A line that a third of all documents hold is counted by partial aggregation,
and its references meet the filter in salted groups and the counts in a join that Spark can split.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id are one document; a null doc_id is
rendered whole and counts for nothing; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cuckoo import CuckooFilter
from tessera.llm.rows import map_text, slices
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import U, texts_of

MIN_CHARS = 10
SHARD_KEYS = 250_000
#: References that meet a shard's filter in one task.
GROUP_REFS = 250_000
_STRIP = b" \t\n\r\x0b\x0c"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo), once for each document and key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = [], []
            for k, text in enumerate(texts_of(batch, 1)):
                found = {key for line in (text or "").encode().split(b"\n") if (key := line_key(line, min_chars))}
                row += [k] * len(found)
                keys += found
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "hi", "lo"])

    return docs.filter("doc_id is not null").mapInArrow(split, "doc_id long, hi long, lo long")


def _render(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): ``docs`` has doc_id, text and ``drop``, the bytes of the keys that go."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1)):
            n, gone, kept = [], [], []
            for text, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                n.append(len(lines))
                if drop:
                    out = {bytes(x) for x in drop}
                    lines = [x for x in lines if line_key(x, min_chars) not in out]
                gone.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept])], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return docs.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string")


def _key_hash() -> F.Column:
    return F.xxhash64("hi", "lo")


class _Segments:
    """A table in parts, newest last, with their numbers of rows."""

    def __init__(self, scratch: Scratch, name: str, merge: Callable[[DataFrame], DataFrame] = lambda x: x, parts: tuple[tuple[DataFrame, int], ...] = ()):
        self.scratch, self.name, self.merge, self.parts = scratch, name, merge, parts

    def add(self, rows: DataFrame) -> _Segments:
        """``rows`` (a written table) as the newest part, merged with those that aren't twice as large."""
        parts, n = list(self.parts), rows.count()
        while parts and parts[-1][1] < 2 * n:
            rows = self.scratch.save(self.merge(parts.pop()[0].unionByName(rows)), self.name)
            n = rows.count()
        return _Segments(self.scratch, self.name, self.merge, (*parts, (rows, n)) if n or not parts else tuple(parts))

    def replaced(self, rows: DataFrame) -> _Segments:
        return _Segments(self.scratch, self.name, self.merge).add(rows)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    def table(self) -> DataFrame | None:
        """All parts, merged where there are several."""
        if not self.parts:
            return None
        out = self.parts[0][0]
        for t, _ in self.parts[1:]:
            out = out.unionByName(t)
        return self.merge(out) if len(self.parts) > 1 else out


def _latest_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.max(F.struct("version", "n", "keeper")).alias("x")).select("hi", "lo", "x.n", "x.keeper", "x.version")


def _latest_filters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.max_by(F.struct("keys", "room", "filter"), "version").alias("x"), F.max("version").alias("version")).select("shard", "x.keys", "x.room", "x.filter", "version")


class LineIndex:
    """Which documents hold which lines. ``insert`` and ``delete`` return the new state and leave the old one as it is."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_chars, self.shard_keys = spark, min_chars, shard_keys
        self.scratch = s = Scratch(spark, "lines")
        self._refs, self._docs, self._gone = _Segments(s, "refs"), _Segments(s, "docs"), _Segments(s, "gone")
        self._counts, self._filters = _Segments(s, "counts", _latest_counts), _Segments(s, "filters", _latest_filters)
        self.version, self.shards, self.shared = 0, 1, 0

    # -- state --------------------------------------------------------------------------------------------------------
    @property
    def refs(self) -> DataFrame:
        """(doc_id, hi, lo) of the documents that remain."""
        return self._live(self._refs.table()).select("doc_id", "hi", "lo")

    @property
    def counts(self) -> DataFrame:
        """(hi, lo, n, keeper) of the lines that remain."""
        return self._counts.table().filter("n > 0").select("hi", "lo", "n", "keeper")

    @property
    def filters(self) -> DataFrame:
        return self._filters.table()

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows with a doc_id whose document wasn't deleted since."""
        gone = self._gone.table()
        if gone is None:
            return rows
        since = gone.groupBy(F.col("doc_id").alias("g_doc")).agg(F.max("version").alias("g_version"))
        return rows.join(since, (rows["doc_id"] == since["g_doc"]) & (rows["version"] < since["g_version"]), "left_anti")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        out, plain = self._next(), _plain(docs, id_col, text_col)
        version = F.lit(out.version)
        new = self.scratch.save(_refs(plain, self.min_chars).distinct().withColumn("version", version), "refs")
        ids = self.scratch.save(plain.filter("doc_id is not null").select("doc_id").distinct().withColumn("version", version), "docs")
        held = self._docs.table()
        if held is not None:
            again = self._live(held).join(ids.select(F.col("doc_id").alias("i")), F.col("doc_id") == F.col("i"), "left_semi").select(F.col("doc_id").alias("i")).distinct()
            if not again.isEmpty():  # these documents' lines may be known
                known = self.refs.join(again, F.col("doc_id") == F.col("i"), "left_semi")
                new = self.scratch.save(new.join(known, ["doc_id", "hi", "lo"], "left_anti"), "refs")
        out._refs, out._docs = self._refs.add(new), self._docs.add(ids)
        delta = _count(new)
        old = self._counts.table()
        if old is None:
            now = delta.withColumn("was", F.lit(0).cast("long"))
        else:
            was = old.select(F.col("hi").alias("h_"), F.col("lo").alias("l_"), F.col("n").alias("was"), F.col("keeper").alias("k_"))
            now = delta.join(was, (F.col("hi") == F.col("h_")) & (F.col("lo") == F.col("l_")), "left")
            kept = F.when(F.col("was") > 0, F.least("keeper", "k_")).otherwise(F.col("keeper"))
            now = now.select("hi", "lo", (F.col("n") + F.coalesce("was", F.lit(0))).alias("n"), kept.alias("keeper"), F.coalesce("was", F.lit(0)).alias("was"))
        return self._finish(out, now)

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        if self._refs.table() is None:
            return self
        out = self._next()
        gone = self.scratch.save(doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("version", F.lit(out.version)), "gone")
        touched = self.scratch.save(self.refs.join(gone.select(F.col("doc_id").alias("i")), F.col("doc_id") == F.col("i"), "left_semi").select("hi", "lo").distinct(), "touched")
        out._gone = self._gone.add(gone)
        left = _count(out.refs.join(touched, ["hi", "lo"], "left_semi"))
        was = self.counts.select("hi", "lo", F.col("n").alias("was")).join(touched, ["hi", "lo"], "left_semi")
        now = was.join(left, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "keeper", "was")
        return self._finish(out, now)

    def _next(self) -> LineIndex:
        out = copy.copy(self)
        out.version = self.version + 1
        return out

    def _finish(self, out: LineIndex, now: DataFrame) -> LineIndex:
        """``out`` with the counts ``now`` (key, n, keeper, was) of the touched keys, and filters that follow them."""
        now = self.scratch.save(now.withColumn("version", F.lit(out.version)), "counts")
        out._counts = self._counts.add(now.drop("was"))
        sign = F.when(F.col("n") > 1, F.lit(1)).otherwise(F.lit(-1))
        change = now.filter("(n > 1) <> (was > 1)").select("hi", "lo", sign.alias("sign"))
        out.shared = self.shared + (change.agg(F.sum("sign")).first()[0] or 0)
        while out.shards * out.shard_keys < out.shared:
            out.shards *= 2
        every = lambda: out._sharded(out.counts.filter("n > 1"))
        old = self.filters
        if old is None or out.shards != self.shards:
            out._filters = self._filters.replaced(self.scratch.save(_build(every(), out.version), "filters"))
            return out
        change = out._sharded(change, "sign")
        sizes = change.groupBy(F.col("shard").alias("s_")).agg(F.sum((F.col("sign") > 0).cast("long")).alias("more"))
        full = sizes.join(old.select("shard", "keys", "room"), F.col("s_") == F.col("shard"), "left").filter(F.coalesce(F.col("keys") + F.col("more") > F.col("room"), F.lit(True))).select("s_")
        full = self.scratch.save(full, "full")
        on = F.col("shard") == F.col("s_")
        touched = old.join(sizes.select("s_").join(full.select("s_"), "s_", "left_anti"), on, "left_semi")
        changed = _change(touched, change.join(full, on, "left_anti"), out.version)
        built = _build(every().join(full, on, "left_semi"), out.version)
        out._filters = self._filters.add(self.scratch.save(changed.unionByName(built), "filters"))
        return out

    def _sharded(self, keys: DataFrame, *also: str) -> DataFrame:
        h = _key_hash()
        return keys.select(F.pmod(F.xxhash64(h), F.lit(self.shards)).alias("shard"), h.alias("h"), *also)

    # -- results ------------------------------------------------------------------------------------------------------
    def drops(self) -> DataFrame:
        """(doc_id, drop): the keys that a document loses, for the documents that lose any."""
        salts = max(1, -(-self._refs.rows // (GROUP_REFS * self.shards)))
        h = _key_hash()
        refs = self.refs.select(F.pmod(F.xxhash64(h), F.lit(self.shards)).alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(salts)).alias("salt"), F.lit(1).alias("side"), "doc_id", "hi", "lo", h.alias("h"), F.lit(None).cast("binary").alias("filter"))
        blank = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "hi", "lo", "h")]
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("side"), *blank, "filter")
        # one task a group: no two of them meet in one while others have none
        both = filters.unionByName(refs).repartitionById(self.shards * salts, (F.col("shard") * salts + F.col("salt")).cast("int")).sortWithinPartitions("shard", "salt", "side")
        maybe = both.mapInArrow(_passing, "doc_id long, hi long, lo long")
        shared = self.counts.filter("n > 1").select("hi", "lo", "keeper")
        lost = maybe.join(shared, ["hi", "lo"]).filter("doc_id <> keeper")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped and ``kept``, the text without the lines that a smaller doc_id holds too."""
        plain, drops = _plain(docs, id_col, text_col), _bytes_of(self.drops())
        joined = plain.join(drops, plain["doc_id"] == drops["d"], "left").select("doc_id", "text", "drop")
        return _render(joined, self.min_chars)

    def cleaned(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """All columns of ``docs``, its texts without the lines that a smaller doc_id holds too; null texts stay null."""
        chars = self.min_chars

        def change(texts: list, drops: list) -> list:
            return [t if t is None or not d else _without(t, d, chars) for t, d in zip(texts, drops, strict=True)]

        return map_text(docs, text_col, _bytes_of(self.drops()), id_col, change)


def _without(text: str, drop: list, min_chars: int) -> str:
    out = {bytes(x) for x in drop}
    return b"\n".join(x for x in text.encode().split(b"\n") if line_key(x, min_chars) not in out).decode()


def _bytes_of(drops: DataFrame) -> DataFrame:
    return drops.select(F.col("doc_id").alias("d"), F.transform("keys", lambda k: F.unhex(F.concat(_little(k["hi"]), _little(k["lo"])))).alias("drop"))


def _little(c: F.Column) -> F.Column:
    """Hex of a long's bytes from the least significant."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))


_FILTERS = "shard long, keys long, room long, filter binary, version int"


def _filter_row(shard: pa.ChunkedArray, f: CuckooFilter, keys: int, version: int) -> pa.Table:
    return pa.table({"shard": shard, "keys": pa.array([keys], pa.int64()), "room": pa.array([f.room], pa.int64()), "filter": pa.array([f.to_bytes()], pa.binary()), "version": pa.array([version], pa.int32())})


def _build(keys: DataFrame, version: int) -> DataFrame:
    """New filters of the keys (shard, h)."""

    def build(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(U)
        f = CuckooFilter.of_size(len(h))
        f.insert(h)
        return _filter_row(table["shard"][:1], f, len(h), version)

    return keys.groupBy("shard").applyInArrow(build, _FILTERS)


def _change(old: DataFrame, change: DataFrame, version: int) -> DataFrame:
    """The filters ``old`` after the keys (shard, h, sign) that come or go, for which they have room."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, sign = right["h"].to_numpy().view(U), right["sign"].to_numpy()
        f = CuckooFilter.from_bytes(left["filter"][0].as_py())
        f.delete(h[sign < 0])
        f.insert(h[sign > 0])
        return _filter_row(left["shard"][:1], f, left["keys"][0].as_py() + int(sign.sum()), version)

    return old.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(run, _FILTERS)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References that their shard's filter lets pass; the filter comes first in its group."""
    at, held = None, None
    for batch in batches:
        shard, salt, side = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]))
        for i, j in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            if (shard[i], salt[i]) != at:
                at, held = (shard[i], salt[i]), None
            if side[i] == 0:
                held = CuckooFilter.from_bytes(batch.column(7)[int(i)].as_py())
                i += 1
            if held is not None and i < j:
                part = batch.slice(int(i), int(j - i))
                ok = pa.array(held.lookup(part.column(6).to_numpy().view(U)))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(ok) for k in (3, 4, 5)], names=["doc_id", "hi", "lo"])


def clean_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated line in the smallest doc_id that holds it only."""
    return LineIndex(docs.sparkSession, min_chars).insert(docs, id_col, text_col).cleaned(docs, id_col, text_col)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for the documents among themselves."""
    return LineIndex(docs.sparkSession, min_chars).insert(docs, id_col, text_col).kept(docs, id_col, text_col)

