"""The pipeline against a brute-force version on a small fixture."""

import random

import corpus_pipeline
from tests.llm.test_dedup import brute, key
from tests.llm.test_texts import brute_counts, brute_language
from tests.llm.test_tokens import pieces_of, valid

from tessera.llm import language_id
from tessera.llm.q_tokens import vocabulary
from tessera.llm.quality_rules import _Judge, fit_references


def fixture():
    rng = random.Random(12)
    common = "the of and to in a is that it was for on".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "th", "on", "re", "st"]) for _ in range(rng.randrange(2, 5))) for _ in range(n))

    texts = [prose(rng.randrange(50, 160)) + "\n" + prose(30) for _ in range(60)]
    near = texts[0].split()
    near[7] = "changed"
    texts += [" ".join(near), " ".join(texts[1].split("\n")) + " tail", "one two three", None, "", "12 34 56 78", "Zqxj wvkk qqzx jjxq vvzq xkqj " * 4, "spam ham spam ham spam " * 20, "A shared footer line of all\n" + prose(60), prose(60) + "\nA shared footer line of all ", "| # | " * 60, prose(40) * 60]
    return [(i * 3 + 1, t, "en" if i % 4 and "qqzx" not in (t or "") else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "line_dedup", "minhash_dedup", "best_fit_packing"]

    # language: by the model's own probabilities, summed by a plain recursion; a null language is filled
    model = language_id.fit(spark.createDataFrame(rows, schema), vocabulary("piece_bpe_32k.model"))
    said = {r[0]: brute_language(model, r[1]) for r in rows}
    left = [(*r[:2], r[2] or said[r[0]][0], *r[3:]) for r in rows if said[r[0]][2] and said[r[0]][1] >= language_id.MIN_SCORE]
    assert any(c.isalpha() for r in rows if r[1] and r[0] not in {x[0] for x in left} for c in r[1])
    docs = stages["language_id"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, docs.collect())) == sorted(left)

    # quality: the base rule, and the verdict from references over what is left
    judge = _Judge(fit_references(spark.createDataFrame(left, schema)))
    good = []
    for r in left:
        n = brute_counts(r[1])
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and judge.passes(*judge.distances(r[1])[:2]):
            good.append(r)
    assert 0 < len(good) < len(left)

    # lines
    held = {}
    for r in good:
        for k in {key(x) for x in r[1].split("\n")} - {None}:
            held.setdefault(k, set()).add(r[0])
    cut = []
    for r in good:
        t = "\n".join(x for x in r[1].split("\n") if not (key(x) and len(held[key(x)]) > 1 and min(held[key(x)]) != r[0]))
        cut.append((r[0], t))
    assert any(t != r[1] for (_, t), r in zip(cut, good, strict=True))

    # near copies on five words, then packing
    comp = {i: c for i, _, c in brute(cut, 5, 80)}
    last = [(i, t) for i, t in cut if comp[i] == i]
    assert len(last) < len(cut)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces_of(last, 4096))
    total = sum(r.length for r in got)
    assert valid(got, 4096) == -(-total // 4096)


def test_stages_keep_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, empty tables and extra columns with clashing names pass every stage."""
    words = " ".join(f"word{k} of the and" for k in range(15))
    rows = [(None, words, None, 1), (5, words + " more", "en", 2), (5, words + " more", "en", 2), (6, None, None, None), (7, "", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long").withColumnRenamed("kept", "gone_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == df.columns
        got = out.collect()
        assert len(got) == {"language_id": 3, "quality_rules": 3, "line_dedup": 5, "minhash_dedup": 5, "best_fit_packing": 5}[name]
        assert stage(spark, df.filter("false"), str(tmp_path)).collect() == []
