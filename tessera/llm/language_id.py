"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass over the word's characters adds them
up. A text's score is the sum over its words, and the prediction the language with the greatest sum plus log prior.

Training is expectation-maximisation: the same lattice, forward and backward, gives the expected number of uses of each
piece in the words of a language. It reads all words of at most about ``max_docs`` training documents of each language,
chosen by a hash of the document number; that bound is a parameter of the fit. Each round is a pass over their distinct
words with counts, which stay in a table; what reaches the driver is one number a piece and language. Scoring reads
whole texts.

Words are lower-cased runs of letters and marks, of any length: those of more than ``LONG`` characters take the same pass
with logarithms, which needs only as many positions as the longest piece has characters.

``keep_known`` rejects texts by the prediction: those without a letter, those whose best language has a score under
``min_score``, those that pieces drawn uniformly explain better than any language (text in none of the languages, or none
at all), and, where ``languages`` is given, those in other languages. Where ``lang_col`` is null the prediction takes its
place. Without a learned language there is nothing to judge by, so all texts with a letter stay.

Defined results: a null text, or one without letters, is ``und`` with score 0; texts of any length are read whole; ties go
to the language first in order; without training rows every text is ``und``; an empty table gives an empty result; a null
id stays null; other columns of the input are not read, and ``lang`` only in training. More than ``MAX_LANGUAGES``
different labels raise.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter, defaultdict, deque
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import numbered, slices
from tessera.llm.scratch import Scratch
from tessera.llm.wordcodec import release_words

UND = "und"
LONG = 40
MAX_DOCS = 1000
ROUNDS = 4
#: What a round of training sends out and brings back has one row a piece and language.
MAX_LANGUAGES = 500
MIN_SCORE = 0.5
#: Distinct words that a worker remembers.
CACHE_WORDS, SLICE_WORDS = 400_000, 60_000
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_HAS_LETTER = regex.compile(r"\p{L}")
#: The vocabulary's mark of a word's beginning.
_BEGIN = "▁"


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def pieces_of_model(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class Lattice:
    """All segmentations of words over a vocabulary, for many words of one length at a time."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in pieces))}
        self.size = len(self.ids) + 1  # the last is any single character that no piece has
        self.longest = max(map(len, self.ids), default=1)

    def spans(self, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(i, j) -> which words have a piece at [i, j), and which piece. All words are equally long."""
        n, get, out = len(words[0]), self.ids.get, {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                ids = np.array([get(w[i:j], -1) for w in words])
                if j == i + 1:
                    ids[ids < 0] = self.size - 1
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    out[i, j] = at, ids[at]
        return out

    def forward(self, spans: dict, n: int, words: int, p: np.ndarray) -> np.ndarray:
        """alpha[i]: words x languages, the probability of the first i characters. p: pieces x languages."""
        alpha = np.zeros((n + 1, words, p.shape[1]))
        alpha[0] = 1
        for (i, j), (at, ids) in sorted(spans.items()):
            alpha[j, at] += alpha[i, at] * p[ids]
        return alpha

    def backward(self, spans: dict, n: int, words: int, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((n + 1, words, p.shape[1]))
        beta[n] = 1
        for (i, j), (at, ids) in sorted(spans.items(), reverse=True):
            beta[i, at] += p[ids] * beta[j, at]
        return beta

    def _groups(self, words: list[str]) -> tuple[dict[int, list[int]], list[str]]:
        """Places of the words by length, the long ones under 0; and the words with the mark of their beginning."""
        marked = [_BEGIN + w for w in words]
        by: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(marked):
            by[len(w) if len(w) <= LONG else 0].append(k)
        return by, marked

    def log_prob(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """words x languages: log of the summed probability of all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        groups, marked = self._groups(words)
        for n, at in groups.items():
            if not n:
                for k in at:
                    out[k] = self._log_prob_long(marked[k], p)
                continue
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                out[some] = np.log(self.forward(self.spans([marked[k] for k in some]), n, len(some), p)[n])
        return out

    def _ends(self, word: str, j: int) -> tuple[list[int], list[int]]:
        """How long the pieces are that end at j, from the shortest, and which they are."""
        get, back, ids = self.ids.get, [], []
        for d in range(1, min(j, self.longest) + 1):
            k = get(word[j - d : j], self.size - 1 if d == 1 else -1)
            if k >= 0:
                back.append(d)
                ids.append(k)
        return back, ids

    def _log_prob_long(self, word: str, p: np.ndarray) -> np.ndarray:
        held: deque = deque([np.zeros(p.shape[1])], maxlen=self.longest)  # logs of the sums up to the last positions
        for j in range(1, len(word) + 1):
            back, ids = self._ends(word, j)
            top = held[-1]
            held.append(top + np.log((np.exp(np.array([held[-d] for d in back]) - top) * p[ids]).sum(0)))
        return held[-1]

    def uses(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in ``words``, each ``counts`` times, under one language's ``p``."""
        out = np.zeros(self.size)
        groups, marked = self._groups(words)
        for n, at in groups.items():
            if not n:
                for k in at:
                    self._uses_long(marked[k], float(counts[k]), p, out)
                continue
            for first in range(0, len(at), 4096):
                some = at[first : first + 4096]
                spans = self.spans([marked[k] for k in some])
                a, b = self.forward(spans, n, len(some), p[:, None]), self.backward(spans, n, len(some), p[:, None])
                weight = counts[some] / a[n, :, 0]
                for (i, j), (place, ids) in spans.items():
                    np.add.at(out, ids, a[i, place, 0] * p[ids] * b[j, place, 0] * weight[place])
        return out

    def _uses_long(self, word: str, count: float, p: np.ndarray, out: np.ndarray) -> None:
        n = len(word)
        a, b = np.zeros(n + 1), np.full(n + 1, -np.inf)
        b[n] = 0
        for j in range(1, n + 1):
            back, ids = self._ends(word, j)
            a[j] = a[j - 1] + math.log((np.exp(a[j - np.array(back)] - a[j - 1]) * p[ids]).sum())
        for j in range(n, 0, -1):
            back, ids = self._ends(word, j)
            at, step = j - np.array(back), np.log(p[ids]) + b[j]
            np.add.at(out, ids, count * np.exp(a[at] + step - a[n]))
            b[at] = np.logaddexp(b[at], step)


@functools.lru_cache(maxsize=1)
def worker_lattice(vocabulary: str) -> Lattice:
    return Lattice(pieces_of_model(vocabulary))


@dataclass
class LanguageModel:
    """``p``: pieces x languages; ``log_prior``: of the languages."""

    vocabulary: str
    languages: list[str]
    p: np.ndarray
    log_prior: np.ndarray

    def __getstate__(self):
        return self.vocabulary, self.languages, self.p.astype(np.float32), self.log_prior

    def __setstate__(self, state):
        self.vocabulary, self.languages, p, self.log_prior = state
        self.p = p.astype(np.float64)

    @property
    def lattice(self) -> Lattice:
        return worker_lattice(self.vocabulary)


def _start(vocabulary: str, docs: dict[str, int]) -> LanguageModel:
    """Uniform pieces and the languages' shares of the documents."""
    languages = sorted(docs)
    size, n = worker_lattice(vocabulary).size, np.array([docs[x] for x in languages], float)
    return LanguageModel(vocabulary, languages, np.full((size, len(languages)), 1 / size), np.log(n / n.sum()) if len(n) else n)


def _step(model: LanguageModel, uses: np.ndarray) -> LanguageModel:
    return LanguageModel(model.vocabulary, model.languages, (uses + 0.05) / (uses + 0.05).sum(0), model.log_prior)


def fit_words(counts: dict[str, Counter], docs: dict[str, int], vocabulary: str, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities from each language's word counts by expectation-maximisation, in this process."""
    model = _start(vocabulary, {x: docs.get(x, 1) for x in counts})
    for _ in range(rounds if counts else 0):
        model = _step(model, np.stack([model.lattice.uses(list(counts[x]), np.array(list(counts[x].values()), float), model.p[:, k]) for k, x in enumerate(model.languages)], 1))
    return model


def _expected(words: DataFrame, model: LanguageModel) -> np.ndarray:
    """pieces x languages: expected uses in the words (lang, word, n)."""
    shared = words.sparkSession.sparkContext.broadcast(model)  # pieces x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        uses, place = np.zeros(model.p.shape), {x: k for k, x in enumerate(model.languages)}
        for batch in batches:
            by: dict[int, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
            for lang, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = by[place[lang]]
                some[0].append(w)
                some[1].append(n)
            for k, (some, n) in by.items():
                uses[:, k] += model.lattice.uses(some, np.array(n, float), model.p[:, k])
        flat = uses.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["pos", "uses"])

    sums = words.mapInArrow(run, "pos long, uses double").groupBy("pos").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(model.p.size)
    out[sums["pos"].to_numpy()] = sums["uses"].to_numpy()
    shared.unpersist()
    return out.reshape(model.p.shape)


def fit(train: DataFrame, vocabulary: str, *, max_docs: int = MAX_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from ``train``'s text and language columns; rows without either are left out."""
    rows = train.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    docs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages in {lang_col}")
    model = _start(vocabulary, docs)
    if not docs:
        return model
    share = F.create_map(*(F.lit(x) for lang, n in docs.items() for x in (lang, min(1.0, max_docs / n) * (1 << 20))))
    chosen = rows.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.update((lang, w) for w in words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    scratch = Scratch(train.sparkSession, "language")
    words = scratch.save(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        model = _step(model, _expected(words, model))
    scratch.drop(words)
    return model


class _Scorer:
    """Words' log probabilities, remembered; the last column is that of pieces drawn uniformly."""

    def __init__(self, model: LanguageModel):
        self.model, self.row = model, {}
        self.p = np.column_stack([model.p, np.full(len(model.p), 1 / max(1, len(model.p)))])
        self.table = np.zeros((0, self.p.shape[1]))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and whether the language explains the text better than uniform pieces."""
        model, lists = self.model, [words_of(t) for t in texts]
        if len(self.row) > CACHE_WORDS + SLICE_WORDS:  # what came after the worker's memory was full was for one slice
            self.row = dict(itertools.islice(self.row.items(), CACHE_WORDS))
        new = list(set().union(*lists).difference(self.row))
        if new:
            at = len(self.row)
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
            if len(self.row) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.row) + 50_000 - len(self.table), self.p.shape[1]))])
            self.table[at : at + len(new)] = model.lattice.log_prob(new, self.p)
        out = []
        for words in lists:
            if not words or not model.languages or not any(_HAS_LETTER.search(w) for w in words):
                out.append((UND, 0.0, False))
                continue
            total = self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
            joint = total[:-1] + model.log_prior
            best = int(np.argmax(joint))
            # the posterior if the text held one word's worth of evidence for each square root of its words: it stays informative
            score = float(1 / np.exp((joint - joint[best]) / math.sqrt(len(words))).sum())
            out.append((model.languages[best], score, bool(total[best] > total[-1])))
        return out


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), and the ``extra`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages floats, fixed by the vocabulary
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    keep = [f for f in rows.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                got = scorer.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns) if k != 1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*(f.name for f in keep), "lang_pred", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, *, min_score: float = MIN_SCORE, languages: Collection[str] | None = None, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages, with all columns; a null ``lang_col`` is filled."""
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    fill = docs.columns.index(lang_col) if lang_col in docs.columns and docs.schema[lang_col].dataType.simpleString() == "string" else None
    plain = numbered(docs)
    allowed = None if languages is None else frozenset(languages)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()  # what this worker remembers from packing has no use here
        scorer = _Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, at):
                got = scorer.texts(part.column(at).to_pylist())
                keep = [fits and score >= min_score and (allowed is None or lang in allowed) for lang, score, fits in got]
                cols = list(part.columns)
                if fill is not None:
                    cols[fill] = pc.coalesce(cols[fill], pa.array([x[0] for x in got], cols[fill].type))
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(judge, plain.schema).toDF(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the document's number as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
