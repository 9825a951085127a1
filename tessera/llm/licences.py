"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression on hashed word one- to three-grams names the licence family of a paragraph, or that it
is a licence of no known family (``unknown``), or none. It is trained here on cuts and variants of the notices in
``NOTICES``; for ``unknown``, on those in ``OTHERS`` and on notices whose distinctive words are exchanged for other words;
and on about ``max_lines`` lines of the documents, chosen by a hash of the line among all lines, which are examples of no
licence unless they resemble a notice. That bound is a parameter.

A temperature calibrates the probabilities. It is fitted on what training has not seen: in each of ``FOLDS`` rounds whole
families, others' notices and lines are left out, and a notice of a family that was left out counts as ``unknown``.

What is predicted is confirmed by comparing the paragraph with the family's notices, on their words and word pairs, each
weighted by how few families have it: what all notices share ("licensed under the ... license") confirms nothing. A
paragraph that no notice confirms is ``unknown``.

Paragraphs are the lines of a text, and runs of lines for notices that are wrapped. A run begins at any line that looks
like a licence or holds a word pair that few families have, and grows, over any number of lines, as long as the
next ``STEP`` lines hold further word pairs of notices; a blank line ends it. All lines of all texts are scored, from hashes of
their words that are taken together.

Defined results: a null or empty text has no paragraphs; rows that repeat are scanned each; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.shingles import U, chunks, mix, texts_of, word_hashes

# Notices by which works name their licence.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Content is available under a Creative Commons Attribution-NonCommercial-NoDerivatives license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Released under the GNU GPL version 2.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "SPDX-License-Identifier: MIT",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "artistic-2.0": (
        "Licensed under the Artistic License 2.0.",
        "This library is free software; you can redistribute it and/or modify it under the Artistic License.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0 Universal.",
        "This work is marked CC0 1.0. Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Licensed under the zlib License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
# Notices of licences that are no family, examples of an unknown one.
OTHERS = (
    "Licensed under the EUPL, Version 1.2 or later.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "This database is made available under the Open Database License.",
    "Licensed under the Python Software Foundation License Version 2.",
    "This program is free software. It comes without any warranty. You can redistribute it under the terms of the Do What The Fuck You Want To Public License.",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Common Development and Distribution License.",
    "You may use this file under the terms of the Business Source License 1.1.",
    "Released under the PostgreSQL License.",
    "This content is licensed under the GNU Free Documentation License.",
    "Contains public sector information licensed under the Open Government Licence v3.0.",
)
UNKNOWN = "unknown"
FAMILIES = ("none", UNKNOWN, *NOTICES)
DIM = 1 << 18
MAX_LINES = 1_500
FOLDS = 3
STEP = 4
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6
#: What a share of the paragraph counts against one of the notice: words of its own may name another licence.
OWN = 0.8
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256))


def _clean(text: bytes) -> bytes:
    """Punctuation becomes space, so that words are letters and digits; lines stay."""
    return text.translate(_PUNCTUATION)


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    h = mix(words + U(1))
    return mix(h[: max(0, len(words) - 1)] * U(0x9E3779B97F4A7C15) + words[1:] + U(2))


def grams(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one- to three-grams (feature numbers) of cleaned paragraphs, and where each paragraph's begin."""
    words, at = word_hashes(paragraphs)
    return _features(words, at)


def _features(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    parts, owners = [], []
    h = np.zeros(len(words), U)
    for k in range(3):
        m = len(words) - k
        if m <= 0:
            break
        h = mix(h[:m] * U(0x9E3779B97F4A7C15) + words[k:] + U(k + 1))
        same = owner[:m] == owner[k:]
        parts.append((h[same] & U(DIM - 1)).astype(np.int64))
        owners.append(owner[:m][same])
    index, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, owners))
    order = np.argsort(own, kind="stable")
    return index[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))])


def pairs(paragraph: bytes) -> frozenset:
    """Word pairs, or the words of a paragraph of one."""
    w = paragraph.lower().split()
    return frozenset(zip(w, w[1:], strict=False)) or frozenset((x,) for x in w)


def terms(paragraph: bytes) -> frozenset:
    """Words and word pairs."""
    w = paragraph.lower().split()
    return frozenset(zip(w, w[1:], strict=False)) | frozenset((x,) for x in w)


@functools.cache
def templates() -> dict[str, list[frozenset]]:
    return {k: [pairs(_clean(t.encode())) for t in v] for k, v in NOTICES.items()}


@functools.cache
def weights() -> dict[tuple, float]:
    """Of the notices' terms: the logarithm of all families over those that have it. Terms of no notice weigh as much as those of one."""
    having = Counter(x for v in NOTICES.values() for x in frozenset().union(*(terms(_clean(t.encode())) for t in v)))
    return {x: math.log(len(NOTICES) / n) for x, n in having.items()}


def _weight(some: frozenset) -> float:
    w, rare = weights(), math.log(len(NOTICES))
    return sum(w.get(x, rare) for x in some)


@functools.cache
def weighted() -> dict[str, list[tuple[frozenset, float]]]:
    """Each family's notices as terms, with their weight."""
    return {k: [(x, _weight(x)) for x in (terms(_clean(t.encode())) for t in v)] for k, v in NOTICES.items()}


def similarity(paragraph: bytes, family: str) -> float:
    """How much of the family's nearest notice the paragraph holds, or of the paragraph the notice, times ``OWN``: the greater weighted share."""
    own = terms(paragraph)
    if not own or family not in NOTICES:
        return 0.0
    mine, long = _weight(own), len(pairs(paragraph)) >= 6
    out = 0.0
    for t, w in weighted()[family]:
        both = _weight(own & t)
        # a share of the paragraph counts only if it is long enough not to be a chance
        out = max(out, both / w, OWN * both / mine if long and mine else 0.0)
    return out


def _telling(plain: list[bytes]) -> np.ndarray:
    """Hashes of the word pairs that at most two families have and none of the ``plain`` lines, sorted."""
    rare = math.log(len(NOTICES) / 2) - 1e-9
    words, at = word_hashes([b" ".join(x) for x, w in weights().items() if len(x) == 2 and w >= rare])
    words_, at_ = word_hashes(plain)
    return np.setdiff1d(_pair_hashes(words)[at[:-1]], _pair_hashes(words_))


def _tells(telling: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which paragraphs hold such a pair."""
    low = np.zeros(1 << 16, bool)  # a first look at 16 bits of the hashes
    low[(telling & U(0xFFFF)).astype(np.int64)] = True
    h = _pair_hashes(words)
    hit = np.flatnonzero(low[(h & U(0xFFFF)).astype(np.int64)])
    hit = hit[np.isin(h[hit], telling)]
    owner = np.searchsorted(at, hit, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[owner[hit + 1 < at[owner + 1]]] = True
    return out


def resembles(paragraph: bytes) -> bool:
    """Whether it holds 0.3 of a notice, or half of it, however short, is in one; such a line is no example of no licence."""
    own = pairs(paragraph)
    return any(len(own & t) >= 0.3 * len(t) or len(own & t) >= 0.5 * len(own) for ts in templates().values() for t in ts) if own else False


_FILLER = "file work text page project documentation author copyright 2019 2021 see also the of for notice".split()


def _variants(notice: str, rng: random.Random, copies: int) -> list[str]:
    """A notice with words dropped, cut to a part, or between other words; first as it is."""
    words, out = notice.split(), [notice] * 3
    for _ in range(copies):
        w = [x for x in words if rng.random() > 0.06]
        if len(w) > 14 and rng.random() < 0.5:
            n = rng.randrange(10, len(w))
            i = rng.randrange(0, len(w) - n + 1)
            w = w[i : i + n]
        if rng.random() < 0.4:
            w = rng.choices(_FILLER, k=rng.randrange(1, 5)) + w
        if rng.random() < 0.4:
            w += rng.choices(_FILLER, k=rng.randrange(1, 5))
        out.append(" ".join(w))
    return out


def variants(seed: int, copies: int) -> list[tuple[str, str]]:
    """(paragraph, family) of the families' notices."""
    rng = random.Random(seed)
    return [(x, family) for family, notices in NOTICES.items() for notice in notices for x in _variants(notice, rng, copies)]


def _strangers(rng: random.Random, names: list[str], copies: int) -> list[str]:
    """Notices whose distinctive words, those of one or two families, are exchanged for ``names``."""
    rare, out = math.log(len(NOTICES) / 2) - 1e-9, []
    w = weights()
    for notice in (t for v in NOTICES.values() for t in v):
        words = notice.split()
        odd = [any(w.get((x,), 0.0) >= rare for x in _clean(word.encode()).decode().lower().split()) for word in words]
        if 0 < sum(odd) <= 6 and len(words) - sum(odd) >= 3:
            out += [" ".join(rng.choice(names).title() if o else word for word, o in zip(words, odd, strict=True)) for _ in range(copies)]
    return out


@dataclass
class Model:
    """``w``: features x families; ``temperature`` divides the scores; ``telling``: hashes of word pairs at which a notice may begin."""

    w: np.ndarray
    b: np.ndarray
    temperature: float
    telling: np.ndarray

    def probabilities(self, paragraphs: list[bytes]) -> np.ndarray:
        return self.scored(paragraphs)[0]

    def scored(self, paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether a paragraph holds a telling word pair."""
        words, begins = word_hashes(paragraphs)
        index, at = _features(words, begins)
        n = np.maximum(1, np.diff(at))
        z = np.zeros((len(paragraphs), self.w.shape[1]))
        some = np.flatnonzero(np.diff(at) > 0)
        if len(some):
            z[some] = np.add.reduceat(self.w[index], at[:-1][some], axis=0)
        return linear.softmax((z / np.sqrt(n)[:, None] + self.b) / self.temperature), _tells(self.telling, words, begins)


Example = tuple[bytes, str]


def _fit(examples: list[Example], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    data, target = _rows(examples)
    w, b = linear.fit(data, target, DIM, link=linear.softmax, epochs=epochs)
    return w.astype(np.float32), b


def _rows(examples: list[Example]) -> tuple[linear.Rows, np.ndarray]:
    index, at = grams([p for p, _ in examples])
    n = np.maximum(1, np.diff(at))
    place = {f: k for k, f in enumerate(FAMILIES)}
    target = np.zeros((len(examples), len(FAMILIES)))
    target[np.arange(len(examples)), [place[f] for _, f in examples]] = 1
    return linear.Rows(at, index, np.repeat(1 / np.sqrt(n), np.diff(at))), target


def _folds(none: list[bytes], rng: random.Random, copies: int) -> list[list[tuple[Example, str]]]:
    """Examples in ``FOLDS`` parts, each with the class that it has where its part is left out: all notices of a family are in one part."""
    names = [w.decode("utf-8", "replace") for p in none[:2000] for w in p.split() if len(w) > 3] or ["frob", "quux"]
    out: list[list[tuple[Example, str]]] = [[] for _ in range(FOLDS)]
    for k, (family, notices) in enumerate(NOTICES.items()):
        out[k % FOLDS] += [((_clean(x.encode()), family), UNKNOWN) for t in notices for x in _variants(t, rng, copies)]
    for k, notice in enumerate(OTHERS):
        out[k % FOLDS] += [((_clean(x.encode()), UNKNOWN), UNKNOWN) for x in _variants(notice, rng, copies)]
    for k, x in enumerate(_strangers(rng, names, max(1, copies // 8))):
        out[k % FOLDS].append(((_clean(x.encode()), UNKNOWN), UNKNOWN))
    for k, p in enumerate(none):
        out[k % FOLDS].append(((p, "none"), "none"))
    return out


def train(negatives: list[bytes], copies: int = 16) -> Model:
    """From the notices and cleaned paragraphs without a licence."""
    rng = random.Random(5)
    words = [w for p in negatives[:2000] for w in p.split()] or [b"text"]
    # licence words alone, or strewn between others, are no notice
    noise = [b" ".join(rng.choices(words, k=12) + rng.sample(b"license licensed version public free software copyright use the under released work".split(), 2)) for _ in range(300)]
    # words that training has not seen are no licence: without a known word the biases alone must say so
    blank = [b""] * (len(negatives) // 2 + 200)
    # nor is what stands around notices
    around = [" ".join(rng.choices(_FILLER, k=rng.randrange(1, 8))).encode() for _ in range(200)]
    folds = _folds([*negatives, *noise, *around, *blank], rng, copies)
    w, b = _fit([e for part in folds for e, _ in part], 60)
    # the temperature, on families, others and lines that were left out; a third of the epochs and every fourth line tell as much
    scores, targets = [], []
    for k, part in enumerate(folds):
        seen = [e for m, other in enumerate(folds) if m != k for j, (e, _) in enumerate(other) if e[1] != "none" or j % 4 == 0]
        vk, bk = _fit(seen, 20)
        data, target = _rows([(p, held) for (p, _), held in part])
        scores.append(data.dot(vk) + bk)
        targets.append(target)
    z, target = np.concatenate(scores), np.concatenate(targets)
    losses = {t: -np.log(np.maximum((linear.softmax(z / t) * target).sum(1), 1e-12)).mean() for t in np.arange(0.2, 5.05, 0.1)}
    return Model(w, b, float(min(losses, key=losses.get)), _telling(negatives))


def fit(docs: DataFrame, *, max_lines: int = MAX_LINES, text_col: str = "text") -> Model:
    """Negatives are about ``max_lines`` lines, chosen by their hash among those of all documents; the bound is a parameter."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t") - F.length(F.translate("t", "\n", "")) + 1), F.lit(0))).first()[0]
    line = rows.select(F.explode(F.split("t", "\n")).alias("line"))
    share = min(1.0, max_lines / max(1, total))
    chosen = line.filter((F.pmod(F.xxhash64("line"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.length("line") > 0)).distinct()
    got = sorted({x for r in chosen.collect() if (x := _clean(r["line"].encode())).strip()})
    return train([x for x in got if not resembles(x)])


def _judged(paragraph: bytes, p: np.ndarray) -> tuple[str, float, float] | None:
    """(family or unknown, probability, similarity) of a paragraph that is a licence."""
    if 1 - p[0] < MIN_PROBABILITY:
        return None
    k = 1 + int(np.argmax(p[1:]))
    s = similarity(paragraph, FAMILIES[k])
    return (FAMILIES[k], float(p[k]), s) if s >= MIN_SIMILARITY else (UNKNOWN, float(1 - p[0]), s)


@functools.cache
def _holders() -> dict[tuple, tuple[str, ...]]:
    """The families that hold a word pair of at most two families."""
    out: dict[tuple, tuple[str, ...]] = {}
    for family, notices in weighted().items():
        for x in frozenset().union(*(t for t, _ in notices)):
            if len(x) == 2 and weights()[x] >= math.log(len(NOTICES) / 2) - 1e-9:
                out[x] = (*out.get(x, ()), family)
    return out


def _run(lines: list[bytes], k: int, taken: set[int], model: Model) -> tuple[int, tuple[str, float, float], tuple[float, int]] | None:
    """The run from line ``k`` that is most like a notice: its length, at least two, and what it is."""
    best, at, n = None, lines[k], 1
    held = {x for x in pairs(at) if x in _holders()}
    while True:
        runs, before = [], len(held)
        while len(runs) < STEP and k + n < len(lines) and lines[k + n].strip() and k + n not in taken:
            line, n = lines[k + n], n + 1
            at += b" " + line
            # the pairs of the line, and that across its beginning
            held.update(x for x in pairs(lines[k + n - 2].split()[-1] + b" " + line) if x in _holders())
            runs.append((n, at, len(held)))
        if len(held) == before:
            return best
        for (m, run, found), p in zip(runs, model.probabilities([r for _, r, _ in runs]), strict=True):
            got = _judged(run, p)
            if got and got[0] != UNKNOWN and (best is None or (got[2], found) > best[2]):
                best = m, got, (got[2], found)
        if len(runs) < STEP:
            return best


def scan_texts(texts: list[bytes], model: Model) -> list[list[tuple[int, int, str, float, float]]]:
    """For each text: (first line, lines, family, probability, similarity) of its licence paragraphs."""
    cleaned = [_clean(t).split(b"\n") for t in texts]
    p, telling = model.scored([x for t in cleaned for x in t])
    out, at = [], 0
    for lines in cleaned:
        found, taken = [], set()
        mine, tell = p[at : at + len(lines)], telling[at : at + len(lines)]
        at += len(lines)
        hint = [k for k in np.flatnonzero((mine[:, 0] <= 1 - MIN_PROBABILITY) | tell).tolist() if lines[k].strip()]
        alone = {k: got for k in hint if (got := _judged(lines[k], mine[k])) is not None}
        for k, got in alone.items():
            if got[0] != UNKNOWN:
                found.append((k, 1, *got))
                taken.add(k)
        for k in hint:  # wrapped notices
            if k in taken:
                continue
            run = _run(lines, k, taken, model)
            if run:
                found.append((k, run[0], *run[1]))
                taken.update(range(k, k + run[0]))
            elif k in alone:
                found.append((k, 1, *alone[k]))
        out.append(sorted(found))
    return out


SCHEMA = "array<struct<line:int,lines:int,family:string,probability:double,similarity:double>>"


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs (lines), found: line, lines, family, probability and similarity of each licence paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col=text_col))  # DIM x families floats
    dtype = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(texts_of(batch, 1)):
                found = [[dict(zip([f.name for f in item], x, strict=True)) for x in t] for t in scan_texts(texts, shared.value)]
                n = [t.count(b"\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(found, pa.list_(item))], names=["doc_id", "n_paragraphs", "found"])
                at += len(texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dtype}, n_paragraphs long, found {SCHEMA}")
