"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on hashed words and word shapes gives each document's own evidence, for quality and for toxicity.
It is fitted on at most ``max_rows`` labelled documents, chosen by a hash of their numbers; that bound is a parameter.

Documents of one host, and of one path on it, tend to be alike. The mean evidence of a host is shrunk towards the global
mean, that of a path towards its host, each by as many pseudo-documents as the spread between sites of that level calls
for (method of moments). A sparse site so falls back on its host, a sparse host on the corpus. A document's posterior odds
are its own odds, moved by how much the odds of its path without itself differ from the global ones.

Everything but the fit is grouped aggregation: counts and sums of whole numbers over all documents, and joins by site. A
host with a third of all rows is summed before the exchange, and its rows join one row, which Spark can split.

Defined results: a null or empty text has the evidence of the bias alone; a null host or path is a site of its own; rows
that repeat are judged each; a null label trains nothing; without labels every document has the prior 0.5 and is kept; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import texts_of

DIM = 1 << 18
MAX_ROWS = 20_000
MIN_ROWS, L1, L2, EPOCHS = 5, 3e-4, 1e-5, 120
HEADS = ("quality", "toxic")
QUALITY_LIMIT, TOXIC_LIMIT = 0.5, 0.25
CACHE_WORDS = 400_000
#: Evidence enters the sums in millionths, so that they don't depend on their order.
_SCALE = 1_000_000
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) % DIM


class Features:
    """Hashed features of texts; a worker remembers those of words."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, w: str) -> tuple[int, int]:
        shape = _DIGITS.sub("0", _LETTERS.sub("a", w))
        return _hash("w" + w.strip(".,;:!?\"'()")), _hash("s" + shape)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values of one text: words it holds, shares of word shapes, and repetition."""
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        pairs = []
        for w in words:
            p = known.get(w)
            if p is None:
                p = self._word(w)
                if len(w) <= 64:
                    known[w] = p
            pairs.append(p)
        ids = np.array(pairs)
        held = np.unique(ids[:, 0])
        shapes, n = np.unique(ids[:, 1], return_counts=True)
        lines = text.split("\n")
        bins = (("d", int(10 * len(held) / len(words))), ("l", int(10 * len(set(lines)) / len(lines))), ("n", len(words).bit_length() // 2))
        index = np.concatenate([held, shapes, [_hash(f"{a}{b}") for a, b in bins]])
        value = np.concatenate([np.ones(len(held)), 4 * n / len(words), np.ones(len(bins))])
        return index, value


@dataclass
class Classifier:
    """``w``: features x heads, float32; ``b``: of the heads."""

    w: np.ndarray
    b: np.ndarray

    def evidence(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return linear.sigmoid((value[:, None] * self.w[index]).sum(0) + self.b)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, heads: tuple[str, ...] = HEADS, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Classifier | None:
    """From at most about ``max_rows`` labelled documents; None without any."""
    known = labels.select(F.col(label_id).cast("string").alias("i"), *(F.col(h).cast("double").alias(h) for h in heads)).filter(F.coalesce(*(F.col(h) for h in heads)).isNotNull())
    n = known.count()
    if not n:
        return None
    chosen = known.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < min(1.0, max_rows / n) * (1 << 20))
    texts = docs.select(F.col(id_col).cast("string").alias("d"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("d") == F.col("i")).select("text", *heads)  # at most max_rows numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features().of
        for batch in batches:
            got = [of(t) for t in texts_of(batch, 0)]
            ends = pa.array(np.cumsum([0, *(len(i) for i, _ in got)]), pa.int32())
            index = np.concatenate([i for i, _ in got] or [np.zeros(0, np.int64)]).astype(np.int32)
            value = np.concatenate([v for _, v in got] or [np.zeros(0)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(1 + k) for k in range(len(heads))), pa.ListArray.from_arrays(ends, pa.array(index)), pa.ListArray.from_arrays(ends, pa.array(value))], names=[*heads, "index", "value"])

    schema = ", ".join(f"{h} double" for h in heads) + ", index array<int>, value array<float>"
    table = rows.mapInArrow(features, schema).toArrow().combine_chunks()
    if not table.num_rows:
        return None
    target = np.stack([table[h].to_numpy() for h in heads], 1)
    lists = table["index"].combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    return train(at - at[0], lists.flatten().to_numpy().astype(np.int64), table["value"].combine_chunks().flatten().to_numpy().astype(np.float64), target)


def train(at: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> Classifier:
    """Without the features of fewer than ``MIN_ROWS`` rows, which would only let it remember single documents; a row without a head's label is not one of that head's."""
    value = np.where(np.bincount(index, minlength=DIM)[index] >= MIN_ROWS, value, 0.0)
    rows, w, b = linear.Rows(at, index, value), np.zeros((DIM, target.shape[1])), np.zeros(target.shape[1])
    for k in range(target.shape[1]):
        known = ~np.isnan(target[:, k])
        if known.any():
            one, bias = linear.fit(rows, np.nan_to_num(target[:, [k]]), DIM, l1=L1, l2=L2, epochs=EPOCHS, rate=0.3, weight=known.astype(float))
            w[:, k], b[k] = one[:, 0], bias[0]
    return Classifier(w.astype(np.float32), b)


def evidence(docs: DataFrame, model: Classifier | None, host: Column, path: Column, heads: tuple[str, ...] = HEADS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path and for each head the document's own probability in millionths."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), *(F.lit(_SCALE // 2 if h == heads[0] else 0).cast("long").alias(h) for h in heads))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x heads floats
    dtype = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, judged = Features().of, shared.value
        for batch in batches:
            p = np.array([judged.evidence(*of(t)) for t in texts_of(batch, 3)]).reshape(-1, len(heads))
            whole = np.clip((p * _SCALE).round().astype(np.int64), 1000, _SCALE - 1000)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(whole[:, k]) for k in range(len(heads)))], names=["doc_id", "host", "path", *heads])

    rows = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {dtype}, host string, path string, " + ", ".join(f"{h} long" for h in heads))


def _strength(groups: DataFrame, n: str, total: str, square: str) -> Column:
    """Pseudo-documents by the method of moments from sites' counts, sums and sums of squares (of shares, not millionths).

    within: the pooled variance in sites; between: what the means of the sites spread beyond that.
    """
    all_n, sites = F.sum(n), F.count("*")
    mean = F.sum(total) / all_n
    within = F.sum(F.col(square) - F.col(total) * F.col(total) / F.col(n)) / F.greatest(all_n - sites, F.lit(1))
    spread = F.sum(F.col(total) * F.col(total) / F.col(n)) - all_n * mean * mean
    n0 = (all_n - F.sum(F.col(n) * F.col(n)) / all_n) / F.greatest(sites - 1, F.lit(1))
    between = F.greatest((spread / F.greatest(sites - 1, F.lit(1)) - within) / F.greatest(n0, F.lit(1e-9)), F.lit(1e-9))
    return F.least(F.greatest(within / between, F.lit(1.0)), F.lit(1e6))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posterior(judged: DataFrame, head: str) -> DataFrame:
    """``judged`` (doc_id, host, path, heads) with ``<head>_site``, the site's share without the document, and ``<head>_p``."""
    p = F.col(head) / _SCALE
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum(head).alias("ps"), F.sum(F.col(head) * F.col(head)).alias("pq"))
    paths = paths.select("host", "path", "pn", (F.col("ps") / _SCALE).alias("ps"), (F.col("pq") / _SCALE / _SCALE).alias("pq"))
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"), F.sum("pq").alias("hq"))
    over = hosts.agg((F.sum("hs") / F.sum("hn")).alias("mean"), _strength(hosts, "hn", "hs", "hq").alias("mh"))
    inside = paths.agg(_strength(paths, "pn", "ps", "pq").alias("mp"))
    sites = paths.withColumnsRenamed({"host": "h_", "path": "p_"}).join(hosts.withColumnRenamed("host", "h2_"), F.col("h_").eqNullSafe(F.col("h2_"))).crossJoin(F.broadcast(over)).crossJoin(F.broadcast(inside))  # the last two are one row
    rows = judged.join(sites, judged["host"].eqNullSafe(F.col("h_")) & judged["path"].eqNullSafe(F.col("p_")))
    host = (F.col("mh") * F.col("mean") + F.col("hs") - p) / (F.col("mh") + F.col("hn") - 1)
    path = (F.col("mp") * host + F.col("ps") - p) / (F.col("mp") + F.col("pn") - 1)
    bound = lambda x: F.greatest(F.least(x, F.lit(0.999)), F.lit(0.001))
    odds = _logit(bound(p)) + _logit(bound(path)) - _logit(bound(F.col("mean")))
    return rows.select(*judged.columns, path.alias(f"{head}_site"), (1 / (1 + F.exp(-odds))).alias(f"{head}_p"))


def quality_classifier(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, doc_quality, site_quality, quality_p, toxic_p, kept: one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    judged = scratch.save(evidence(docs, model, host, path, id_col=id_col, text_col=text_col), "evidence")
    out = posterior(judged, "quality")
    # toxicity is a property of a text, not of its neighbours: its own evidence decides
    return out.select("doc_id", (F.col("quality") / _SCALE).alias("doc_quality"), F.round("quality_site", 9).alias("site_quality"), F.round("quality_p", 9).alias("quality_p"), (F.col("toxic") / _SCALE).alias("toxic_p"), ((F.col("quality_p") >= QUALITY_LIMIT) & (F.col("toxic") < TOXIC_LIMIT * _SCALE)).alias("kept"))
