"""Near copies, vectors and lines against brute force, and their defined edge cases."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components as comps
from tessera.llm import near_dedup as nd
from tessera.llm.components import components
from tessera.llm.cuckoo import CuckooFilter
from tessera.llm.line_dedup import LineIndex, clean_lines, dedup_lines
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import shingle_hashes, word_hashes
from tessera.llm.vector_dedup import vector_dedup


def roots(n, links):
    up = {i: i for i in n}

    def f(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = f(a), f(b)
        up[max(a, b)] = min(a, b)
    return {i: f(i) for i in n}


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, pct):
    s = [(i, sets_of(t, width)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(s) for b, y in s[:k] if x and 100 * len(x & y) >= pct * len(x | y)]
    r = roots({i for i, _ in rows}, links)
    return sorted((i, len(x), r[i]) for i, x in s)


def near_rows(seed, n=120):
    """Texts, near copies in chains, exact copies, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(n // 12):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
            base = t if g % 3 == 0 else base  # chains drift
    out += [None, "", "  \n\t ", "one", "One", "a b", "A  b", out[0], out[0].upper(), "x " * 5000, "é É ß"]
    ids = list(range(100, 100 + len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 4, 512), (2, 5, 512), (3, 4, 3)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, seed, width, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = near_rows(seed)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string")
    got = nd.near_dedup(df.repartition(5), width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_dedup_one_large_group_of_near_copies(spark, monkeypatch):
    """Many blocks, most pairs under the threshold."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(200):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, None), (7, "other words here entirely now then")], "doc_id long, text string")
    got = nd.near_dedup(df).collect()
    assert len(got) == 5
    by = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got]
    assert by.count((5, 2, 5, True)) == 2
    assert (None, 2, None, True) in by and (3, 0, 3, True) in by
    # a doc_id with two texts joins the groups of both
    two = spark.createDataFrame([(1, "a b c d e f"), (9, "a b c d e f"), (9, "g h i j k l"), (4, "g h i j k l")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in nd.near_dedup(two).collect()} == {(1, 1), (9, 1), (4, 1)}
    assert nd.near_dedup(df.filter("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\té\x0b\x1c ", max_size=30), min_size=1, max_size=5))
def test_words_are_runs_between_ascii_spaces(texts):
    words, at = word_hashes([t.encode() for t in texts])
    assert np.diff(at).tolist() == [len(t.encode().split()) for t in texts]
    flat = [w for t in texts for w in t.encode().lower().split()]
    assert len(set(words.tolist())) == len(set(flat))
    for width in (1, 4):
        hashes, begins = shingle_hashes([t.encode() for t in texts], width)
        for k, t in enumerate(texts):
            assert len(set(hashes[begins[k] : begins[k + 1]].tolist())) == len(sets_of(t, width))


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """The driver's components are those of the rounds, and cost two tables, not one a round."""
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (-3, 9)]
    df, got = spark.createDataFrame(edges, "a long, b long"), []
    for limit in (0, comps.LOCAL_EDGES):
        monkeypatch.setattr(comps, "LOCAL_EDGES", limit)
        scratch = Scratch(spark, "test")
        got.append({x.node: x.component for x in components(df, scratch).collect()})
    want = roots({i for e in edges for i in e}, edges)
    assert got[0] == got[1] == {k: v for k, v in want.items() if k != v} and scratch._n == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    want = roots({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


# -- vectors ----------------------------------------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark, monkeypatch):
    from tessera.llm import vector_dedup as vd

    monkeypatch.setattr(vd, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 16))
    near = np.concatenate([x[:3].repeat(30, 0) + 0.12 * rng.standard_normal((90, 16)), x, x[:4]])
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(len(near)), near, strict=True)]
    d = np.array([r for _, r in rows])
    d /= np.sqrt((d * d).sum(1))[:, None]
    c = d @ d.T
    ids = [i for i, _ in rows]
    assert not ((c > 0.949999) & (c < 0.950001)).any()
    r = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(c >= 0.95, 1)), strict=True)])
    want = sorted((ids[k], int((c[k] >= 0.95).sum()) - 1, r[ids[k]]) for k in range(len(ids)))
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0, 2.0]), (906, [None] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *odd]], "vec_id long, embedding array<double>, n_links int")
    got = vector_dedup(df).collect()
    assert sorted((q.vec_id, q.n_links, q.component_id) for q in got if q.vec_id < 900) == want
    assert sorted((q.vec_id, q.n_links, q.component_id, q.kept) for q in got if q.vec_id >= 900) == [(i, 0, i, True) for i, _ in odd]
    assert vector_dedup(df.filter("false")).collect() == []
    none = vector_dedup(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {(q.vec_id, q.n_links, q.component_id, q.kept) for q in none} == {(None, 0, None, True), (1, 0, 1, True)}


@pytest.mark.parametrize("dim", [64, 100])
def test_the_estimate_is_unbiased_and_bounded(dim):
    from tessera.llm.vector_dedup import EPSILON, Codes

    rng = np.random.default_rng(0)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 1500, dim)))
    y[:700] = x[:700] + 0.03 * y[:700]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = Codes.of(x, np.arange(1500)), Codes.of(y, np.arange(5000, 6500))
    a = Codes.from_rows(dim, *a.rows())  # as executors get them
    estimate, left, rounding = a.estimates(b)
    bound = EPSILON * np.sqrt((1 - (x @ y.T) ** 2) * left[None, :] + rounding)
    error = estimate - x @ y.T
    one = np.diag(error)
    assert abs(one[700:].mean()) < 4 * one[700:].std() / np.sqrt(800) and abs(one[:700].mean()) < 4 * one[:700].std() / np.sqrt(700)
    assert (np.abs(error) <= bound).mean() > 1 - 1e-5 and bound.mean() < 0.8 and np.diag(bound)[:700].mean() < 0.3
    i, j = a.likely(b, 0.95)
    assert set(zip(*np.nonzero(x @ y.T >= 0.95), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_very_small_and_very_large_vectors(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [-1e308, 0.0])]
    got = vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_a_hot_bucket_with_few_links_is_refined(spark, monkeypatch):
    """Members that share a bucket and little more meet in finer ones; the result is the same."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "REFINE", 20)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(2, 7)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    called, finer = [], nd._finer
    monkeypatch.setattr(nd, "_finer", lambda *a: called.append(1) or finer(*a))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert called and sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)


def test_hot_keys_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from tessera.llm import skew

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1500).alias("k"), "id")
    one = rows.groupBy("k").agg(F.max("id").alias("v"), F.count("*").alias("c")).filter("c > 1")
    want = sorted(map(tuple, rows.join(one, "k").select("k", "id", "v").collect()))
    got = skew.join_one(rows, one, ["k"], ["v"], "c", F.col("id"))
    assert sorted(map(tuple, got.collect())) == want
    # the salt is a key of the join: an exchange is by it too
    assert "s_salt" in "".join(x for x in got._jdf.queryExecution().toString().split("\n") if "hashpartitioning" in x) or "BroadcastHashJoin" in got._jdf.queryExecution().toString()


# -- lines ------------------------------------------------------------------------------------------------------------
def key(line):
    k = line.strip(" \t\n\r\x0b\x0c")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def brute_lines(rows):
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) > 1 and min(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows(seed, ids):
    rng = random.Random(seed)
    pool = [f"a common line number {k}" for k in range(6)] + ["short", "", "ÄÖÜ äöü ßß12", "  A Common LINE number 1\t", " A common line number 1", "ééééééééé", "éééééééééé"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(1, 9)))) for i in ids]


def digest(rows):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows)


def test_lines_equal_brute_force(spark):
    rows = [*line_rows(1, range(40)), (90, None), (91, ""), (92, "\n\n"), (93, "x" * 200_000 + "\na common line number 1")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    assert digest(dedup_lines(df.repartition(3)).collect()) == brute_lines(rows)
    assert dedup_lines(df.filter("false")).collect() == []
    cleaned = clean_lines(df)
    assert cleaned.columns == df.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[90] is None and hashlib.sha256(texts[93].encode()).hexdigest() == next(x[3] for x in brute_lines(rows) if x[0] == 93)


def test_inserts_and_deletes_are_reversible(spark):
    a, b = line_rows(2, range(0, 30, 2)), line_rows(3, range(1, 30, 2))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = LineIndex(spark, shard_keys=2).insert(frame(a))
    both = one.insert(frame(b))
    assert digest(both.kept(frame(a + b)).collect()) == brute_lines(a + b)
    back = both.delete(frame(b).select("doc_id"))
    assert digest(back.kept(frame(a)).collect()) == brute_lines(a)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, one.refs.collect()))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    # the first holder goes, the next keeps the line
    first = min(i for i, _ in a)
    rest = [r for r in a if r[0] != first]
    assert digest(one.delete(frame(a[:1]).select("doc_id")).kept(frame(rest)).collect()) == brute_lines(rest)


def test_growing_inserts_and_deletes(spark):
    """Ten inserts, each larger than the one before, with deletes between: the rows, the counts and the filters' load."""
    index, held, next_id, rng = LineIndex(spark, shard_keys=300), {}, 0, random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    lines = [f"line of the pool number {k}" for k in range(2000)]
    for step in range(10):
        size = 3 + 2 * step * step
        rows = [(next_id + k, "\n".join([*rng.sample(lines, 6), f"its own line {next_id + k}", "a line of all documents"])) for k in range(size)]
        next_id += size
        if step == 4:  # a document comes again with more lines, and one that was deleted comes back
            rows += [(0, held[0] + "\na line of all documents\nanother one of it"), back]
        index = index.insert(frame(rows))
        for i, t in rows:
            held[i] = t
        if step % 3 == 2:
            out = rng.sample(sorted(set(held) - {0}), len(held) // 4)
            back = (out[0], held[out[0]])
            index = index.delete(frame([(i, "") for i in out]))
            held = {i: t for i, t in held.items() if i not in out}
        if step in (4, 9):
            assert digest(index.kept(frame(list(held.items()))).collect()) == brute_lines(list(held.items()))
        filters = [(r.keys, r.room, CuckooFilter.from_bytes(bytes(r.filter))) for r in index.filters.collect()]
        assert all(keys <= room and not f.stash and np.count_nonzero(f.table) == keys for keys, room, f in filters)
        assert sum(k for k, *_ in filters) == index.shared == index.counts.filter("n > 1").count()
    assert index.shards > 1 and len(index._refs.parts) <= 8
    fresh = LineIndex(spark).insert(frame(list(held.items())))
    assert sorted(map(tuple, index.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
    assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))


def test_null_ids_and_repeated_rows_of_lines(spark):
    df = spark.createDataFrame([(None, "the same long line"), (4, "the same long line"), (4, "the same long line"), (7, "the same long line")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_dropped) for r in dedup_lines(df).collect()))
    assert got == [(-1, 0), (4, 0), (4, 0), (7, 1)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, min_size=1, max_size=600), st.integers(0, 600))
def test_cuckoo_filter(keys, cut):
    keys = np.array(keys, np.uint64)
    f = CuckooFilter.of_size(len(keys) // 2)  # too small: kicks and the stash are needed
    f.insert(keys[: len(keys) // 2])
    f = CuckooFilter.from_bytes(f.to_bytes())
    f.insert(keys[len(keys) // 2 :])
    assert f.lookup(keys).all()
    f.delete(keys[:cut])
    assert f.lookup(keys[cut:]).all()
    f.delete(keys[cut:])
    assert not f.table.any() and not f.stash
