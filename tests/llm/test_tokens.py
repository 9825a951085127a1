"""Token counts, packing and the piece codec against the libraries, and their defined edge cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, piece_codec, wordcodec
from tessera.llm.q_tokens import vocabulary
from tessera.llm.token_counts import token_counts

JSON, MODEL = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "a", "Hello, World. it's I'd 12,5 don't.", "<|endoftext|> x <|STARTOFTEXT|> <|startoftext|>.", "ÅÅ é. ́x İi K", "日本語。テスト ok", "😀 😀.", "x" * 5000, "a b c\x0b\x1cd", "....,,,", "A.B.C. e.g. 3.14", "\x00\x01", "ab, " * 4000]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def lib_ids(texts):
    return [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_word_tokenizer_equals_the_library(spark, monkeypatch):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aAbBcdeE .,'<|>\n\té1ß") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [np.array(i, "<u4").tobytes() for i in lib_ids(texts)]
    assert list(wordcodec.WordTokenizer(JSON).encode(texts)) == want
    monkeypatch.setattr(wordcodec, "SLICE_BYTES", 50)  # every text is long, and the worker's memory always full
    assert list(wordcodec.WordTokenizer(JSON, cache_words=10).encode(texts)) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_tokenizer_on_any_text(text):
    assert list(wordcodec.worker_tokenizer(JSON).encode([text])) == [np.array(lib_ids([text])[0], "<u4").tobytes()]


def test_token_counts(spark):
    rows = [*enumerate(ODD), (None, "a b"), (50, None), (51, "z"), (51, "z")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts(df, JSON, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := len(lib_ids([t or ""])[0]), n > 3) for i, t in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert token_counts(df.filter("false"), JSON).collect() == []


def test_token_counts_of_long_texts():
    """Cut at white space into several parts in several batches."""
    from tessera.llm import token_counts as tc

    long = ["Hello, World. it's <|endoftext|> 12,5 É " * 40_000, "x" * 1_500_000, "日本 " * 300_000, None, "a"]
    assert tc._counter(JSON)(long) == [len(x) for x in lib_ids([t or "" for t in long])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(spark, name):
    path = vocabulary(name)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        want = [len(e) for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(ODD)]
    assert [r.n_tokens for r in sorted(token_counts(df, path).collect())] == want


# -- packing ----------------------------------------------------------------------------------------------------------
def valid(rows, capacity):
    """Gapless sequences within the capacity; returns how many."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seats in by.values():
        at = 0
        for o, n in sorted(seats):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def pieces_of(rows, capacity, end=1):
    out = []
    for i, t in rows:
        ids = np.array([*lib_ids([t or ""])[0], end], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            out.append((i, p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())))
    return out


def test_pack(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [*map(tuple, docs), (-1, None), (-2, ""), (None, "a b"), (-3, "w " * 9000), (-4, "z"), (-4, "z")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int")
    got = packing.pack(df, JSON, shard_items=40).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, pieces_of(rows, 4096)))
    total = sum(r.length for r in got)
    assert -(-total // 4096) <= valid(got, 4096) <= -(-total // 4096) + 1
    assert packing.pack(df.filter("false"), JSON).collect() == []


@pytest.fixture
def few_levels(monkeypatch):
    pack_level, seen = packing._pack_level, []

    def counted(items, n_shards, *rest, **options):
        seen.append(n_shards)
        assert len(seen) <= 4, f"shards by level: {seen}"
        return pack_level(items, n_shards, *rest, **options)

    monkeypatch.setattr(packing, "_pack_level", counted)


def test_pack_ends_on_empty_texts(spark, few_levels):
    df = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(5000)], "doc_id long, text string")
    got = packing.pack(df, JSON).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == [(i, 0, 1) for i in range(5000)]
    assert valid(got, 4096) == 2


def test_pack_ends_with_a_third_of_texts_empty(spark, few_levels):
    rng = random.Random(4)
    size = [1 if i % 3 == 0 else min(4000, max(2, int(rng.lognormvariate(5, 1)))) for i in range(20_000)]
    items = spark.createDataFrame(list(enumerate(size)), "uid long, length int")
    got = packing.pack_items(items, *packing.count_and_tokens(items), packing.Scratch(spark, "test")).join(items, "uid").collect()
    assert sorted(r.uid for r in got) == list(range(20_000))
    assert -(-sum(size) // 4096) <= valid(got, 4096) <= -(-sum(size) // 4096) + 1


def test_the_genetic_algorithm_repairs_what_best_fit_misses():
    rng = random.Random(1)
    capacity, size = 1000, []
    for _ in range(40):  # bins that can be filled exactly by three
        a, b = rng.randrange(200, 500), rng.randrange(150, 400)
        size += [a, b, capacity - a - b]
    rng.shuffle(size)
    down = sorted(range(len(size)), key=lambda i: -size[i])
    greedy = packing.best_fit(down, size, capacity)
    best, crossed = packing.evolve(size, capacity, 200, 12, 0)
    assert crossed
    assert sorted(i for b in best for i in b) == list(range(len(size)))
    assert all(sum(size[i] for i in b) <= capacity for b in best)
    assert packing.lower_bound(size, capacity) == 40 <= len(best) < len(greedy)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(0, 5))
def test_crossover_keeps_every_item_once(size, seed):
    rng = random.Random(seed)
    order = list(range(len(size)))
    a = packing.best_fit(order, size, 50)
    rng.shuffle(order)
    b = packing.best_fit(order, size, 50)
    for child in (packing.crossover(a, b, size, 50, rng), packing.mutate(a, size, 50, rng)):
        assert sorted(i for x in child for i in x) == list(range(len(size)))
        assert all(sum(size[i] for i in x) <= 50 for x in child)


def test_every_shard_is_evolved_and_its_elites_migrate(spark):
    """The query's own path, with its default parameters: best fit alone would already reach the bound."""
    docs, report = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    got = packing.pack(docs, JSON, report=report).collect()
    islands = [r for t in report for r in t.collect()]
    assert {(r.shard, r.island) for r in islands if r.level == 0} >= {(0, 0), (0, 1)}
    for r in islands:
        assert r.crossed >= packing.MIN_GENERATIONS * packing.MIN_EPOCHS and r.migrated >= packing.MIN_EPOCHS - 1
    total = sum(r.length for r in got)
    assert valid(got, 4096) == -(-total // 4096)


def test_evolution_gathers_free_space():
    rng = random.Random(3)
    size = [min(900, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(600)]
    down = sorted(range(len(size)), key=lambda i: -size[i])
    greedy = packing.best_fit(down, size, 1000)
    best, crossed = packing.evolve(size, 1000, 6, 6, 0)
    assert crossed >= 2 and packing.fitness(best, size, 1000) <= packing.fitness(greedy, size, 1000) and sorted(i for b in best for i in b) == sorted(down)


# -- pieces -----------------------------------------------------------------------------------------------------------
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=250, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst .,\n▁"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_codec_equals_the_library(text):
    codec, m = piece_codec.worker_codec(MODEL), model()
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == m.encode(text)
    assert codec.decode(ids) == m.decode(m.encode(text))


def test_streaming_commits_within_the_window():
    v = piece_codec.worker_codec(MODEL).v
    for text in ("x" * 500, "abcab" * 300, "▁" * 300, "日本" * 200, "internationalisation" * 40):
        s, out, most = piece_codec.Stream(v), [], 0
        for c in text:
            out += s.feed(c)
            most = max(most, len(s.text))
        assert most <= 8 * v.longest
        assert len(out) > 0
        out += s.close()
        # the path is that of merging the whole text by rank
        assert out == [v.pieces[p] for p in v.merged(text)]


def test_unigram_viterbi_takes_the_best_sum():
    class Toy:
        bpe, longest, byte_ids, unknown, lowest = False, 3, {}, 0, -6.0
        pieces = {"a": 1, "b": 2, "ab": 3, "abb": 4, "bb": 5}
        score = [0.0, -2.0, -2.0, -2.5, -6.0, -2.2]

    Toy.endings = piece_codec.Vocabulary.endings.func(Toy)

    s = piece_codec.Stream(Toy())
    assert s.feed("abb") + s.close() == [1, 5]  # -4.2 beats -4.5 and -6
    assert s.feed("ab") + s.close() == [3]
    long = "abb" * 50
    got = s.feed(long) + s.close()
    best = [0.0]
    for n in range(1, len(long) + 1):
        best.append(max(best[n - k] + Toy.score[Toy.pieces[long[n - k : n]]] for k in (1, 2, 3) if n >= k and long[n - k : n] in Toy.pieces))
    assert abs(sum(Toy.score[i] for i in got) - best[-1]) < 1e-9


def message(*fields):
    """A protocol buffer of (number, value) fields: whole numbers, floats and bytes."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def test_a_unigram_model_equals_the_library(tmp_path):
    """A model file written by hand: the type comes from the file, and the greatest sum is what the library takes."""
    import sentencepiece

    rng = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((c, -rng.uniform(3, 6), 1) for c in "▁abcde")]
    for _ in range(60):
        p = "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
        pieces.append((("▁" if rng.random() < 0.4 else "") + p, -rng.uniform(3, 12), 1))
    pieces = list({p[0]: p for p in pieces}.values())
    data = message(*((1, message((1, p.encode()), (2, float(s)), (3, k))) for p, s, k in pieces), (2, message((3, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    codec, m = piece_codec.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert piece_codec.model_type(str(path)) == "unigram" and piece_codec.model_type(MODEL) == "bpe"
    for _ in range(300):
        text = "".join(rng.choice("abcde  ") for _ in range(rng.randrange(1, 120)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == m.encode(text)
    assert np.frombuffer(codec.encode("abcx" * 500), "<u4").tolist() == m.encode("abcx" * 500)


def test_codec_over_tables(spark):
    df = spark.createDataFrame([*((i, t, 0) for i, t in enumerate(ODD)), (None, "a b", 0), (60, None, 0), (61, "q", 0), (61, "q", 0)], "doc_id long, text string, ids int")
    m = model()
    enc = piece_codec.encode(df, MODEL)
    got = sorted(((r.doc_id, list(r.ids)) for r in enc.collect() if r.doc_id is not None))
    assert got[: len(ODD)] == [(i, m.encode(t)) for i, t in enumerate(ODD)] and (60, []) in got and got.count((61, m.encode("q"))) == 2
    back = {r.doc_id: r.text for r in piece_codec.decode(enc, MODEL).collect()}
    assert all(back[i] == m.decode(m.encode(t)) for i, t in enumerate(ODD))
    dig = {r.doc_id: r for r in piece_codec.digests(df, MODEL).collect()}
    assert dig[3].n_ids == len(m.encode(ODD[3])) and dig[3].round_trip and dig[60].n_ids == 0
    assert piece_codec.digests(df.filter("false"), MODEL).collect() == []
