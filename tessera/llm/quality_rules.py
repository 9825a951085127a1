"""Quality rules by distribution divergence from language references.

A text has two histograms: of its characters by class, and of its words by the common words of all languages, all others
being one cell. A language's references are the means of the histograms of its texts, each text with the same weight; all
texts of at least the minimum length enter. A text fails if its Jensen-Shannon distance (base 2, 0 to 1) to the nearest
language's reference is over the limit, for characters or for words. From the squared distance goes what a sample of the
text's length has on average from its own source: each cell adds 1 / (8 ln 2 n), or half its share where so few are
expected in n that their absence adds less. Shorter texts than the minimum lengths are not compared at all.

Base counts beside: code points in words, symbols, repeated lines, and words in five-word windows that occur twice.

Defined results: a null text has no words, lines or symbols; texts of fewer than ten words fail the base rule; rows that
repeat are judged each; a null language enters no reference, and a table without languages has no references, so that
only the base rule holds; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import keep_rows, slices
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import U, mix, texts_of, word_hashes

CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "symbol", "other")
COMMON = 40
MIN_CHARS, MIN_WORDS = 200, 40
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.37
WINDOW = 5
MIN_TEXT_WORDS, MAX_REPEAT_PCT = 10, 20
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_STOPS = frozenset(".,;:!?'\"()-¿¡«»“”‘’…–—")
#: Millionths: shares are summed as whole numbers, so that sums don't depend on their order.
_SCALE = 1_000_000
_FLUSH = 200_000


def char_class(c: str) -> int:
    if c in _SPACES:
        return 4
    if c in _STOPS:
        return 5
    kind = unicodedata.category(c)
    if kind == "Ll":
        return 0
    if kind in ("Lu", "Lt"):
        return 1
    if kind[0] in "LM":
        return 2
    if kind[0] == "N":
        return 3
    return 6 if kind[0] in "SP" else 7


def _class_table() -> np.ndarray:
    return np.array([char_class(chr(c)) if not 0xD800 <= c < 0xE000 else 7 for c in range(0x10000)] + [7], np.uint8)


_table: list[np.ndarray] = []


def char_histogram(text: str) -> np.ndarray:
    if not _table:
        _table.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(_table[0][np.minimum(points, 0x10000)], minlength=len(CLASSES))


def plain_words(text: str) -> list[str]:
    """Lower-cased words without the punctuation at their ends."""
    return [w.strip(".,;:!?'\"()") for w in text.lower().split()]


def repeated_words(data: bytes, window: int = WINDOW) -> tuple[int, int]:
    """Words, and those of them in ``window``-word windows that occur at least twice, the first included."""
    words = _hashes(data)
    n = len(words)
    if n <= window:
        return n, 0
    h = np.zeros(n - window + 1, U)
    for j in range(window):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[j : j + len(h)])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return n, int((np.cumsum(edge) > 0).sum())


def _hashes(data: bytes) -> np.ndarray:
    return word_hashes([data], lower=False)[0]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    n, repeated = repeated_words(data)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return n, len(text) - sum(map(text.count, _SPACES)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


@dataclass
class References:
    """Common words in order, and each language's mean histograms (languages x classes, languages x words + 1)."""

    languages: list[str]
    words: list[str]
    chars_mean: np.ndarray
    words_mean: np.ndarray


def fit_references(docs: DataFrame, *, common: int = COMMON, text_col: str = "text", lang_col: str = "lang") -> References:
    """Over all texts of the minimum lengths. What comes to the driver are ``common`` words of each language and two histograms."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in (x for batch in batches for x in slices(batch, 1)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = plain_words(text)
                if len(words) < MIN_WORDS or len(text) < MIN_CHARS:
                    continue
                one = _SCALE / len(words)
                for w, c in Counter(words).items():
                    found[lang, 0, w] += round(one * c)
                hist = char_histogram(text)
                for k, c in enumerate((_SCALE * hist / hist.sum()).round().astype(int).tolist()):
                    found[lang, 1, str(k)] += c
                found[lang, 2, ""] += _SCALE
                if len(found) > _FLUSH:
                    yield _rows(found)
                    found.clear()
        yield _rows(found)

    scratch = Scratch(docs.sparkSession, "references")
    sums = scratch.save(rows.mapInArrow(shares, "lang string, kind int, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "shares")
    by: dict[str, tuple[dict, np.ndarray, int]] = {}
    top = sums.filter("kind > 0").unionByName(_top(sums.filter("kind = 0"), common))
    for r in top.collect():
        words, chars, n = by.setdefault(r["lang"], ({}, np.zeros(len(CLASSES)), [0]))
        if r["kind"] == 0:
            words[r["word"]] = r["n"]
        elif r["kind"] == 1:
            chars[int(r["word"])] = r["n"]
        else:
            n[0] = r["n"]
    langs = sorted(by)
    every = sorted({w for x in langs for w in by[x][0]})
    # the shares of all languages' common words in each language
    wanted = docs.sparkSession.createDataFrame([(w,) for w in every] or [("",)], "w string")
    shares_of = {(r["lang"], r["word"]): r["n"] for r in sums.filter("kind = 0").join(F.broadcast(wanted), F.col("word") == F.col("w"), "left_semi").collect()} if every else {}
    scratch.drop(sums)
    words_mean = np.array([[shares_of.get((x, w), 0) / by[x][2][0] for w in every] for x in langs]).reshape(len(langs), len(every))
    words_mean = np.concatenate([words_mean, np.maximum(0, 1 - words_mean.sum(1, keepdims=True))], 1)
    chars_mean = np.array([by[x][1] / max(1, by[x][1].sum()) for x in langs]).reshape(len(langs), len(CLASSES))
    return References(langs, every, chars_mean, words_mean)


def _top(words: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of each language; Spark keeps k rows of each task before the exchange."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return words.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _rows(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "kind", "word", "n"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between a distribution and each row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def less_noise(distance: float, source: np.ndarray, n: int) -> float:
    """A distance without the mean squared distance that a sample of n has from its source."""
    noise = np.minimum(source / 2, 1 / (8 * np.log(2) * n)).sum() - 1 / (8 * np.log(2) * n)
    return float(np.sqrt(max(0.0, distance**2 - max(0.0, noise))))


class _Judge:
    def __init__(self, refs: References):
        self.refs, self.at = refs, {w: k for k, w in enumerate(refs.words)}

    def distances(self, text: str) -> tuple[float | None, float | None, str | None]:
        """To the nearest language by characters and by words, null under the minimum length; and which is nearest by words."""
        refs = self.refs
        if not refs.languages:
            return None, None, None
        chars, words, near = None, None, None
        if len(text) >= MIN_CHARS:
            h = char_histogram(text)
            d = js_distance(h / h.sum(), refs.chars_mean)
            chars = less_noise(d.min(), refs.chars_mean[int(d.argmin())], len(text))
        found = plain_words(text)
        if len(found) >= MIN_WORDS:
            n = len(refs.words)
            h = np.bincount(np.fromiter((self.at.get(w, n) for w in found), np.int64, len(found)), minlength=n + 1)
            d = js_distance(h / h.sum(), refs.words_mean)
            words, near = less_noise(d.min(), refs.words_mean[int(d.argmin())], len(found)), refs.languages[int(d.argmin())]
        return chars, words, near

    def verdict(self, text: str | None) -> tuple:
        """The base counts, base_failed, both distances and kept."""
        base = base_counts(text)
        failed = base[0] < MIN_TEXT_WORDS or 100 * base[4] > MAX_REPEAT_PCT * base[0]
        chars, words, _ = self.distances(text or "")
        return (*base, failed, chars, words, not failed and self.passes(chars, words))

    @staticmethod
    def passes(chars: float | None, words: float | None) -> bool:
        return (chars is None or chars <= CHAR_LIMIT) and (words is None or words <= WORD_LIMIT)


def keep_good(docs: DataFrame, refs: References | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_references(docs, text_col=text_col, lang_col=lang_col) if refs is None else refs)

    def judge():
        of = _Judge(shared.value)
        return lambda texts: [of.verdict(t)[-1] for t in texts]

    return keep_rows(docs, text_col, judge)


def quality_rules(docs: DataFrame, refs: References | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept."""
    found = fit_references(docs, text_col=text_col, lang_col=lang_col) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(found)  # COMMON words and two short histograms a language
    dtype = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            out = [judge.verdict(text) for text in texts_of(batch, 1)]
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, f"doc_id {dtype}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")
