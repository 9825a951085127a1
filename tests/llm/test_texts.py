"""Language ID, quality rules, the quality classifier and licences: brute force, held-out accuracy, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import language_id, licences, linear, quality_classifier, quality_rules
from tessera.llm.q_text import op2_language_id, op3_quality_rules, op6_quality_classifier, op8_licence_scan
from tessera.llm.q_tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


# -- languages --------------------------------------------------------------------------------------------------------
def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(words):
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca"]
    lat = language_id.Lattice(pieces)
    p = np.linspace(1, 2, lat.size)[:, None]
    p /= p.sum()
    by = {q: float(p[i, 0]) for q, i in lat.ids.items()}
    for n in {len(w) for w in words}:
        some = [w for w in words if len(w) == n]
        spans = lat.spans(some)
        a, b = lat.forward(spans, n, len(some), p), lat.backward(spans, n, len(some), p)
        want = [all_segmentations(w, by) for w in some]
        assert np.allclose(a[n, :, 0], want) and np.allclose(b[0, :, 0], want)


def test_words_of_any_length_take_the_same_pass(monkeypatch):
    m = language_id.fit_words({"x": Counter({"abab": 5, "ba": 3, "cab": 2}), "y": Counter({"ccc": 4, "bc": 4})}, {"x": 1, "y": 1}, MODEL, 2)
    words, counts = ["abab", "kabab", "z", "ccccc", "日本語", "abcabcabcab"], np.array([1.0, 2, 3, 4, 5, 6])
    logs, uses = m.lattice.log_prob(words, m.p), m.lattice.uses(words, counts, m.p[:, 0])
    monkeypatch.setattr(language_id, "LONG", 3)
    assert np.allclose(m.lattice.log_prob(words, m.p), logs) and np.allclose(m.lattice.uses(words, counts, m.p[:, 0]), uses)
    # the sum over segmentations across what was a cut: a long word is no more probable than its parts without the sum
    (whole,) = m.lattice.log_prob(["ab" * 4000], m.p)
    assert np.isfinite(whole).all() and (whole < -4000).all()


def test_fit_in_spark_equals_fit_in_one_process(spark):
    rows = [(i, "the cat and the dog " + "ab" * 30, "en") for i in range(5)] + [(i, "der hund und die katze", "de") for i in range(9, 12)] + [(20, None, "en"), (21, "no label", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), MODEL)
    counts = {"en": Counter(), "de": Counter()}
    for _, t, x in rows:
        if t and x:
            counts[x].update(t.split())
    want = language_id.fit_words(counts, {"en": 5, "de": 3}, MODEL)
    assert model.languages == want.languages == ["de", "en"] and np.allclose(model.p, want.p) and np.allclose(model.log_prior, want.log_prior)


def brute_language(model, text):
    """Language, score, and whether it beats uniform pieces, by a plain recursion over the segmentations."""
    columns = [*model.p.T, np.full(len(model.p), 1 / len(model.p))]
    ids = model.lattice.ids

    def total(word, p):
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum(ways[i] * p[ids[word[i:j]]] for i in range(j) if word[i:j] in ids) + (ways[j - 1] * p[-1] if word[j - 1] not in ids else 0)
        return np.log(ways[-1])

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0, False
    logs = [sum(total("▁" + w, p) for w in words) for p in columns]
    joint = np.array(logs[:-1]) + model.log_prior
    k = int(joint.argmax())
    return model.languages[k], 1 / sum(np.exp((x - joint[k]) / np.sqrt(len(words))) for x in joint), logs[k] > logs[-1]


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, MODEL, max_docs=100)
    rows = [(r.doc_id, r.text[:300]) for r in docs.orderBy("doc_id").limit(40).collect()] + [(-1, "zqxj wvkk qqzx jjxq vvzq xkqj"), (-2, "Zażółć gęślą jaźń"), (-3, "12 !!"), (-4, None), (-5, "the")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    want = {i: brute_language(model, t) for i, t in rows}
    assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-4 for i, w in want.items())
    kept = {r.doc_id: r.lang for r in language_id.keep_known(df, model).collect()}
    assert kept == {i: w[0] for i, w in want.items() if w[2] and w[1] >= language_id.MIN_SCORE}
    # a letter alone doesn't save a text
    assert -1 not in kept and any(c.isalpha() for c in rows[-5][1]) and len(kept) >= 40
    assert {r.doc_id for r in language_id.keep_known(df, model, languages=["de"]).collect()} == {i for i, x in kept.items() if x == "de"}
    assert language_id.keep_known(df, model, min_score=1.1).count() == 0


def test_an_unlabelled_corpus_stays(spark):
    df = spark.createDataFrame([(1, "the of and", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    model = language_id.fit(df, MODEL)
    assert model.languages == [] and [r.doc_id for r in language_id.keep_known(df, model).collect()] == [1]


def test_expectation_maximisation_raises_the_likelihood():
    counts = {"x": Counter({"abab": 5, "ba": 3, "cab": 2}), "y": Counter({"ccc": 4, "bc": 4})}
    likes = []
    for rounds in (1, 3, 6):
        m = language_id.fit_words(counts, {"x": 1, "y": 1}, MODEL, rounds)
        likes.append(float(m.lattice.log_prob(["abab", "ba", "cab"], m.p)[:, 0] @ [5, 3, 2]))
    assert likes == sorted(likes)


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    import zlib

    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out & (out.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.99


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, MODEL, max_docs=60)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the of and to that is was"), (5, "der und die nicht " * 20_000), (5, "der und die nicht"), (None, "le les et des que"), (7, "日本" * 300), (8, "a" * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "fr")} <= got
    kept = language_id.keep_known(df, model)
    # letters of scripts that no language has are explained no better than by chance
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, None}
    assert language_id.predict(df.filter("false"), model).collect() == []
    blank = language_id.fit(docs.filter("false"), MODEL)
    assert {r.lang_pred for r in language_id.predict(df, blank).collect()} == {"und"}


# -- quality rules ----------------------------------------------------------------------------------------------------
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aaab \n\t\x0b\x1c#|é ", max_size=120)))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == brute_counts(text)


def test_base_counts_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_quality_rules(spark, SF).collect():
        want = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_clean_documents_stay_and_junk_goes(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op3_quality_rules(spark, SF).join(labels, "doc_id").toPandas()
    good, bad = out[(out.quality == 1) & ~out.base_failed], out[(out.quality == 0) & (out.n_words >= 40)]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.15


def test_js_distance_and_edges(spark):
    p = np.array([0.5, 0.5, 0.0])
    assert quality_rules.js_distance(p, np.array([p, [0.0, 0.0, 1.0]])).tolist() == [0.0, 1.0]
    rows = [(1, None, "en"), (2, "", None), (3, "w " * 60_000, "en"), (4, " ".join(f"word{k}" for k in range(30)), None), (None, "a b", "xx"), (4, "a b", "xx")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == 6 and {(r.doc_id, r.kept) for r in got} >= {(1, False), (2, False), (3, False), (4, True), (None, False), (4, False)}
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df).count() == 1
    assert quality_rules.quality_rules(df.filter("false")).collect() == []


def brute_verdicts(rows):
    """(characters' distance, words' distance, kept) from scratch; rows: (id, text, lang)."""
    import unicodedata

    spaces, stops = " \t\n\r\x0b\x0c", ".,;:!?'\"()-¿¡«»“”‘’…–—"

    def kind(c):
        k = unicodedata.category(c)
        if c in spaces:
            return "space"
        if c in stops:
            return "stop"
        if k in ("Ll", "Lu", "Lt"):
            return {"Ll": "lower"}.get(k, "upper")
        return {"L": "letter", "M": "letter", "N": "digit", "S": "symbol", "P": "symbol"}.get(k[0], "other")

    def shares(items):
        n = Counter(items)
        return {k: v / sum(n.values()) for k, v in n.items()}

    words_of = lambda t: [w.strip(".,;:!?'\"()") for w in t.lower().split()]
    texts = {}
    for _, t, lang in rows:
        if t and lang and len(t) >= 200 and len(words_of(t)) >= 40:
            texts.setdefault(lang, []).append(t)
    mean = lambda ds: {k: sum(d.get(k, 0) for d in ds) / len(ds) for k in set().union(*ds)}
    chars = {x: mean([shares(map(kind, t)) for t in ts]) for x, ts in texts.items()}
    words = {x: mean([shares(words_of(t)) for t in ts]) for x, ts in texts.items()}
    common = {w for d in words.values() for w in sorted(d, key=lambda w: (-round(d[w], 6), w))[:40]}
    fold = lambda d: {**{w: d.get(w, 0) for w in common}, None: 1 - sum(d.get(w, 0) for w in common)}

    def distance(p, refs, n):
        best = None
        for q in refs.values():
            keys = set(p) | set(q)
            js = sum((p.get(k, 0) * np.log2(2 * p[k] / (p[k] + q.get(k, 0))) if p.get(k, 0) > 0 else 0) + (q.get(k, 0) * np.log2(2 * q[k] / (p.get(k, 0) + q[k])) if q.get(k, 0) > 0 else 0) for k in keys) / 2
            noise = sum(min(v / 2, 1 / (8 * np.log(2) * n)) for v in q.values()) - 1 / (8 * np.log(2) * n)
            if best is None or js < best[0]:
                best = js, noise
        return np.sqrt(max(0, best[0] - max(0, best[1])))

    folded, out = {x: fold(d) for x, d in words.items()}, {}
    for i, t, _ in rows:
        t, n = t or "", brute_counts(t)
        a = distance(shares(map(kind, t)), chars, len(t)) if len(t) >= 200 else None
        b = distance(fold(shares(words_of(t))), folded, len(words_of(t))) if len(words_of(t)) >= 40 else None
        ok = n[0] >= 10 and 100 * n[4] <= 20 * n[0]
        out[i] = a, b, ok and (a is None or a <= 0.30) and (b is None or b <= 0.37)
    return out


def test_verdicts_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, "| # | " * 90, None), (-2, None, "en"), (-3, "0123 4567 " * 50, "en"), (-4, " ".join(f"q{k}zx" for k in range(90)), None)]
    want = brute_verdicts(rows)
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    close = lambda a, b: a is b if a is None or b is None else abs(a - b) < 1e-3
    near = 0
    for r in got:
        a, b, kept = want[r.doc_id]
        assert close(r.char_distance, a) and close(r.word_distance, b)
        edge = any(x is not None and abs(x - limit) < 1e-3 for x, limit in ((a, 0.30), (b, 0.37)))
        near += edge
        assert r.kept == kept or edge
    assert near <= 1 and 0 < sum(r.kept for r in got) < len(got) and any(not k and a and b for a, b, k in want.values())


def test_evidence_equals_brute_force():
    """A document's own probability from its features one by one, and the fit's optimality."""
    rng = random.Random(2)
    good, bad = "river stone meadow cloud harbour".split(), "buy now cheap pills click".split()
    texts = [" ".join(rng.choices((good if k % 2 else bad) + ["the", "of"], k=30)) for k in range(80)]
    of = quality_classifier.Features().of
    got = [of(t) for t in texts]
    at = np.cumsum([0, *(len(i) for i, _ in got)])
    target = np.array([[k % 2, np.nan if k % 3 else 0.0] for k in range(80)], float)
    model = quality_classifier.train(at, np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got]), target)
    for t in ["river of stone", "cheap pills now now", ""]:
        index, value = of(t)
        z = float(model.b[0]) + sum(float(model.w[i, 0]) * float(v) for i, v in zip(index, value, strict=True))
        assert abs(model.evidence(index, value)[0] - 1 / (1 + np.exp(-z))) < 1e-6
    assert model.evidence(*of("river stone meadow"))[0] > 0.8 > 0.2 > model.evidence(*of("buy cheap pills"))[0]
    # rows without a toxic label train nothing: those with one are all 0
    assert all(model.evidence(*of(t))[1] < 0.3 for t in texts)


# -- the classifier ---------------------------------------------------------------------------------------------------
def brute_posterior(rows, head=2):
    """Moments and shrinkage by plain loops; rows: (host, path, p)."""
    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[head])
        return out

    def strength(g):
        n = sum(map(len, g.values()))
        k, mean = len(g), sum(map(sum, g.values())) / n
        within = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in g.values()) / max(n - k, 1)
        spread = sum(sum(v) ** 2 / len(v) for v in g.values()) - n * mean * mean
        n0 = (n - sum(len(v) ** 2 for v in g.values()) / n) / max(k - 1, 1)
        between = max((spread / max(k - 1, 1) - within) / max(n0, 1e-9), 1e-9)
        return min(max(within / between, 1.0), 1e6)

    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    mh, mp = strength(hosts), strength(paths)
    mean = sum(r[head] for r in rows) / len(rows)
    out = []
    for r in rows:
        h, p = hosts[r[0]], paths[r[:2]]
        host = (mh * mean + sum(h) - r[head]) / (mh + len(h) - 1)
        path = (mp * host + sum(p) - r[head]) / (mp + len(p) - 1)
        b = lambda x: min(max(x, 0.001), 0.999)
        odds = sum(s * np.log(b(x) / (1 - b(x))) for s, x in ((1, r[head]), (1, path), (-1, mean)))
        out.append((path, 1 / (1 + np.exp(-odds))))
    return out


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        h = rng.choice(["a", "a", "b", "c", None]) if k > 5 else f"lone{k}"
        rows.append((h, rng.choice(["x", "y", None]), round(min(max(rng.gauss({"a": 0.9, "b": 0.3}.get(h, 0.6), 0.15), 0.002), 0.998), 6)))
    df = spark.createDataFrame([(i, h, p, round(v * 1e6)) for i, (h, p, v) in enumerate(rows)], "doc_id long, host string, path string, quality long")
    got = {r.doc_id: (r.quality_site, r.quality_p) for r in quality_classifier.posterior(df, "quality").collect()}
    assert np.allclose([got[i] for i in range(len(rows))], brute_posterior(rows), atol=1e-6)


def test_classifier_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op6_quality_classifier(spark, SF).join(labels, "doc_id").toPandas()
    assert ((out.quality_p >= 0.5) == (out.quality == 1)).mean() > 0.97


def test_classifier_generalises(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.quality_classifier(docs, labels.filter("doc_id % 3 <> 0"), F.col("source"), F.col("lang")).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((out.quality_p >= 0.5) == (out.quality == 1)).mean() > 0.98
    assert out[(out.quality == 1) & (out.toxic == 0)].kept.mean() > 0.97 and out[out.toxic == 1].kept.mean() < 0.45


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "h", None, 1), (2, "", None, "p", 0), (3, "x " * 40_000, "h", "p", 1), (3, "y", "h", "p", 1), (None, "z", "g", "p", 1)], "doc_id long, text string, source string, lang string, kept int")
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(docs, none, F.col("source"), F.col("lang")).collect()
    assert len(got) == 5 and all(r.kept and r.doc_quality == 0.5 for r in got)
    some = docs.sparkSession.createDataFrame([(1, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert len(quality_classifier.quality_classifier(docs, some, F.col("source"), F.col("lang")).collect()) == 5
    assert quality_classifier.quality_classifier(docs.filter("false"), some, F.col("source"), F.col("lang")).collect() == []


def test_sparse_regression_finds_the_weights():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.4).astype(float)
    y = (x @ [3, -3, 0, 0, 0, 0] + rng.standard_normal(400) * 0.3 > 0).astype(float)
    at = np.concatenate([[0], np.cumsum((x > 0).sum(1))])
    w, _ = linear.fit(linear.Rows(at, np.nonzero(x)[1], np.ones(int(x.sum()))), y[:, None], 6, epochs=200, l1=1e-3)
    assert w[0, 0] > 1 and w[1, 0] < -1 and np.abs(w[2:, 0]).max() < 1


# -- licences ---------------------------------------------------------------------------------------------------------
def test_licence_scan_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {"mit": "MIT License", "apache-2.0": "Apache License", "gpl": "General Public License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved."}
    hits = total = false = 0
    for r in op8_licence_scan(spark, SF).collect():
        want = {f for f, m in marks.items() if m in docs[r.doc_id]}
        got = set(filter(None, r.families.split(",")))
        hits, total, false = hits + len(want & got), total + len(want), false + len(got - want - {"unknown"})
    assert total and hits == total and not false


def test_licence_scan_finds_every_planted_line(spark):
    marks = {"mit": "MIT License", "apache-2.0": "Apache License", "gpl": "General Public License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved."}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {(i, k, f) for i, t in texts.items() for k, line in enumerate(t.split("\n")) for f, m in marks.items() if m in line}
    got = {(r.doc_id, f.line, f.family) for r in licences.scan(docs).collect() for f in r.found if f.family != "unknown"}
    assert sum(f == "proprietary" for *_, f in want) == 66 and got == want


def test_short_licence_lines_are_no_negatives():
    clean = licences._clean
    assert all(licences.resembles(clean(x)) for x in (b"All rights reserved.", b"All rights", b"MIT License", b"the BSD License", b"Copyright 2020 X. All rights reserved."))
    assert not any(licences.resembles(clean(x)) for x in (b"", b"reserved", b"the quick brown fox jumps over it", b"all about software and its use in public"))


@pytest.fixture(scope="module")
def scanner():
    return licences.train([licences._clean(w.encode()) for w in ("the quick brown fox jumps over it", "all about software and its use in public", "version three of the text was free", "we copy files under the desk")] * 30)


def test_licence_variants_and_unknown(scanner):
    held = licences.variants(77, 4)
    p = scanner.probabilities([licences._clean(t.encode()) for t, _ in held])
    assert np.mean([licences.FAMILIES[k] == f for k, (_, f) in zip(p.argmax(1), held, strict=True)]) > 0.95
    wrapped = b"first line here\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files to deal in the Software without\nrestriction, including the rights to use, copy, modify and merge\nlast words of the page"
    (found,) = licences.scan_texts([wrapped], scanner)
    assert {f[2] for f in found} == {"mit"}
    # wrapped over more lines than a step
    words = licences.NOTICES["mit"][2].split()
    thin = "\n".join(["before", *(" ".join(words[k : k + 4]) for k in range(0, len(words), 4)), "", "after"]).encode()
    (found,) = licences.scan_texts([thin], scanner)
    assert {f[2] for f in found} == {"mit"} and max(f[1] for f in found) > licences.STEP


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Licensed under the Artistic License 2.0", {"artistic-2.0"}), ("Released under the zlib license.", {"zlib", "unknown"}), ("Released under the Unlicense", {"unlicense"}),
        ("This work is marked with CC0 1.0 Universal, Public Domain Dedication", {"cc0", "unknown"}), ("Licensed under the GNU Affero General Public License v3", {"agpl"}),
        ("Licensed under the Frobnicate License, Version 2.0.", {"unknown"}), ("Licensed under the Frobnicate Public Agreement, release nine.", {"unknown"}), ("This program is distributed under the terms of the Zorble Public License, version 4.", {"unknown"}),
        ("Released under the European Space Agency Community License.", {"unknown"}),
    ],
)
def test_licences_that_share_words_with_others(scanner, line, want):
    (found,) = licences.scan_texts([line.encode()], scanner)
    assert len(found) == 1 and found[0][2] in want


def brute_similarity(paragraph, family):
    """Weighted shares by plain loops over words."""
    clean = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower()).split()
    def all_terms(w):
        return {(x,) for x in w} | {(w[k], w[k + 1]) for k in range(len(w) - 1)}
    families = {f: [all_terms(clean(t)) for t in v] for f, v in licences.NOTICES.items()}
    def weight(x):
        n = sum(any(x in t for t in v) for v in families.values())
        return np.log(len(families) / max(n, 1))
    w = clean(paragraph)
    own, best = all_terms(w), 0.0
    for t in families[family]:
        both = sum(weight(x) for x in own & t)
        best = max(best, both / sum(weight(x) for x in t))
        if len({(w[k], w[k + 1]) for k in range(len(w) - 1)}) >= 6:
            best = max(best, licences.OWN * both / sum(weight(x) for x in own))
    return best


def test_template_comparison_equals_brute_force():
    rng = random.Random(8)
    lines = [t for t, _ in rng.sample(licences.variants(5, 3), 25)] + list(licences.OTHERS)
    for t in lines:
        for f in rng.sample(sorted(licences.NOTICES), 4):
            assert abs(licences.similarity(licences._clean(t.encode()), f) - brute_similarity(t, f)) < 1e-9


def test_families_left_out_are_unknown(monkeypatch):
    """Trained without a family, its notices are no other family's."""
    negatives = [licences._clean(w.encode()) for w in ("the quick brown fox jumps over it", "all about software and its use in public", "version three of the text was free")] * 30
    wrong = total = 0
    for out in ("artistic-2.0", "zlib", "epl-2.0", "mpl-2.0"):
        monkeypatch.setattr(licences, "NOTICES", {k: v for k, v in FULL_NOTICES.items() if k != out})
        monkeypatch.setattr(licences, "FAMILIES", ("none", "unknown", *licences.NOTICES))
        for c in (licences.templates, licences.weights, licences.weighted, licences._holders):
            c.cache_clear()
        model = licences.train(negatives, copies=10)
        for t in FULL_NOTICES[out]:
            total += 1
            wrong += any(f[2] != "unknown" for f in licences.scan_texts([t.encode()], model)[0])
    monkeypatch.undo()
    for c in (licences.templates, licences.weights, licences.weighted, licences._holders):
        c.cache_clear()
    assert wrong == 0 and total >= 8


FULL_NOTICES = dict(licences.NOTICES)


def test_licence_edges(spark, scanner):
    rows = [(1, None), (2, ""), (3, "w\n" * 30_000 + "Licensed under CC BY-NC 4.0."), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "x")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, found string")
    got = licences.scan(df, scanner).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.n_paragraphs, tuple((f.line, f.family) for f in r.found)) for r in got}
    assert by == {(1, 0, ()), (2, 0, ()), (3, 30_001, ((30_000, "cc-by-nc"),)), (4, 1, ((0, "mit"),)), (None, 1, ())}
    assert licences.scan(df.filter("false"), scanner).collect() == []
    assert licences.scan(df.filter("false")).collect() == []
