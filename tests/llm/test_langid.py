import random

import numpy as np
import pyarrow as pa

from lectern.llm import langid as L

SOUNDS = {"aa": ["tho", "ing", "wer", "and", "the"], "bb": ["che", "ung", "sch", "über", "eit"], "cc": ["ción", "ado", "que", "los", "ña"]}


def sample(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n, seed):
    return [(i, sample(lang, seed * 1000 + i), lang) for i, lang in enumerate(list(SOUNDS) * n)]


def test_held_out(spark):
    model = L.fit(spark.createDataFrame(rows(40, 1), "doc_id long, text string, lang string"), clusters=3)
    assert sorted(set(model.languages)) == sorted(SOUNDS)
    test = rows(20, 2)
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i]["language"] == lang for i, _, lang in test]) >= 0.98
    strange = L.identify(spark.createDataFrame([(1, "жяц ъыщ " * 80), (2, "12 34 !! " * 30)], "doc_id long, text string"), model).collect()
    assert {r["language"] for r in strange} == {"und"}


def test_counts_are_those_of_a_loop():
    texts = ["über den", "", "a1b  c", "ñ"]
    got, letters = L.counts(pa.array(texts, pa.large_string()))
    for t, row, n in zip(texts, got, letters):
        code = [int(L._CODE[b]) for b in t.encode()]
        kept = [c for i, c in enumerate(code) if c != 32 or (i and code[i - 1] != 32) or i == 0]
        want = np.zeros(L.DIMS)
        for size in (1, 2, 3):
            for i in range(len(kept) - size + 1):
                if size == 1 and kept[i] == 32:
                    continue
                g = 0
                for c in kept[i : i + size]:
                    g = (g * 257 + c) % 2**32
                want[((g * 2654435761 + size * 40503) % 2**32) >> 20] += 1
        assert (row == want).all() and n == sum(c != 32 for c in code)


def test_nearest_centroid_is_brute_force(spark):
    model = L.fit(spark.createDataFrame(rows(30, 3), "doc_id long, text string, lang string"), clusters=2)
    texts = pa.array([t for _, t, _ in rows(5, 4)], pa.large_string())
    x, _ = L.vectors(texts, model.idf)
    lang, cos, _ = model.predict(texts)
    for v, got, c in zip(x, lang, cos):
        best = max(range(len(model.centroids)), key=lambda j: float(v @ model.centroids[j]))
        assert got == model.languages[best] and abs(c - float(v @ model.centroids[best])) < 1e-5


def test_rare_languages_have_centroids(spark):
    many = [(i, sample("aa", i, 8), "aa" if i % 40 == 0 else None) for i in range(6000)]
    few = [(10_000 + i, sample("bb", i, 60), "bb") for i in range(8)] + [(20_000 + i, sample("cc", i, 8), "cc") for i in range(12)]
    df = spark.createDataFrame(many + few + [many[0]] * 5, "doc_id long, text string, lang string")
    model = L.fit(df, sample_rows=60)
    assert [model.languages.count(x) for x in SOUNDS] == [4, 4, 4] and (model.limits > 0).all()
    got = {r["doc_id"]: r["language"] for r in L.identify(df, model).collect()}
    assert np.mean([got[i] == x for i, _, x in few]) == 1 and np.mean([got[i] == "aa" for i, *_ in many]) > 0.98
    assert [L._level(c, 100) for c in ([1000, 10, 50], [20, 30], [500, 500], [])] == [45, 30, 50, 0]


def test_hard_rows(hard, empty):
    model = L.fit(hard)
    got = L.identify(hard, model).collect()
    assert len(got) == hard.count()
    by = {r["doc_id"]: r["language"] for r in got}
    assert by[102] == by[103] == by[104] == "und"
    none = L.fit(empty)
    assert L.identify(empty, none).collect() == [] and {r["language"] for r in L.identify(hard, none).collect()} == {"und"}
