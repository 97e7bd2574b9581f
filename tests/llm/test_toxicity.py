import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import toxicity as T
from tests.llm.conftest import words

STEMS = ["zagro", "mulke"]  # insults of a language without a lexicon


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = words(1000 + seed * 10_000 + i, rng.randint(30, 150)).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randint(3, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "pathetic", "moron"]) if i % 16 else rng.choice(STEMS) + rng.choice(["ba", "ti", "no"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows(spark, model):
    docs, labels = corpus(300, seed=6)
    got = {r["doc_id"]: r["is_toxic"] for r in T.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    hits = [got[i] for i, y in labels if y]
    false = [got[i] for i, y in labels if not y]
    assert np.mean(hits) >= 0.9 and np.mean(false) <= 0.01
    kept = {r["doc_id"] for r in T.drop_toxic(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert kept == {i for i, t in got.items() if not t}


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n, m = 60_000, len(T.NAMES)
    y = rng.random(n) < 0.1
    rate = np.stack([np.full(m, 0.01), np.full(m, 0.5)])
    for j, name in enumerate(T.NAMES):
        if name in T.CLEAN:
            rate[:, j] = (0.5, 0.02)
    fired = rng.random((n, m)) < rate[y.astype(int)]
    fired[:, 1] = fired[:, 0]  # one voter repeats another
    masks, counts = np.unique(fired @ (1 << np.arange(m)), return_counts=True)
    model = T.label_model(masks, counts.astype(float))
    assert abs(model["balance"] - 0.1) < 0.02
    assert np.abs(model["rate"][1][2:9] - 0.5).max() < 0.06 and model["rate"][0][2:9].max() < 0.03
    assert model["correlation"][0, 1] > 0.8 and model["correlation"][2, 3] < 0.3 and model["share"][0] < model["share"][3]
    p = T.posterior(model, fired @ (1 << np.arange(m)))
    assert ((p > 0.5) == y).mean() > 0.98


def test_many_mined_words_all_vote(spark):
    rng = random.Random(8)
    bad = ["".join(rng.choice("gjkmvz") + rng.choice("aou") for _ in range(5)) for _ in range(150)]
    docs = [(i, " ".join([words(i, 4), *(bad[(5 * i + k) % 150] for k in range(5))])) for i in range(300)] + [(i, words(i, 10)) for i in range(300, 1500)]
    labels = [(i, int(i < 300)) for i in range(1500)]
    got = T.mine(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 20_000, "doc_id", "text")
    assert set(T._hashes(" ".join(bad)).tolist()) <= set(got[0].tolist())


WORD = re.compile(rb"[a-z'\x80-\xff]+")


def split(text):
    return WORD.findall((text or "").lower().encode())


def hashed(word: bytes) -> dict[int, int]:
    """The hashes under which a word (0) and its beginnings are in tables."""
    t = T.tokens(pa.array([word.decode(errors="surrogateescape")], pa.large_string()) if word.isascii() else pa.array([word], pa.large_binary()).view(pa.large_string()))
    return {0: int(t.h[0])} | {size: int(h[0]) for size, (_, h) in t.begin.items() if len(h)}


def brute_votes(text, mined, dense, long):
    """Voters that fire, number of hits, hit words: word by word, from the docstring's rules."""
    w = split(text)
    veto = set(mined.get(-1, np.zeros(0, np.uint64)).tolist())
    lexicons = {n: {x.encode() for x in v.lower().split()} for n, v in T.LEXICONS.items()}
    keys = [hashed(x) for x in w]
    of = {n: [i for i, x in enumerate(w) if x in words_ and keys[i][0] not in veto] for n, words_ in lexicons.items()}
    tables = {k: set(v.tolist()) for k, v in mined.items() if k >= 0}
    of["beginnings"] = [i for i, k in enumerate(keys) if any(k.get(size) in tables.get(size, ()) for size in T.BEGINNINGS)]
    of["words"] = [i for i, k in enumerate(keys) if k[0] in tables.get(0, ())]
    hits = sorted(set().union(*of.values()))
    second = {x.encode() for x in T.SECOND_PERSON.split()}
    fires = {n for n, at in of.items() if at}
    fires |= {"two_different"} if len({w[i] for i in hits}) >= 2 else set()
    fires |= {"three_hits"} if len(hits) >= 3 else set()
    fires |= {"dense"} if len(hits) >= max(1, dense * len(w)) else set()
    fires |= {"second_person"} if any(w[j] in second for i in hits for j in range(max(0, i - 3), min(len(w), i + 4))) else set()
    if w and not hits:
        fires.add("no_hit_short" if len(w) < long else "no_hit_long")
    return fires, len(hits), w, keys


def brute_score(text, model):
    fires, hits, w, keys = brute_votes(text, model.mined, model.dense, model.long)
    if not w:
        return fires, 0.0, 0.0
    label, logit = model.label, math.log(model.label["balance"] / (1 - model.label["balance"]))
    for j, name in enumerate(T.NAMES):
        clean, toxic = label["rate"][0][j], label["rate"][1][j]
        logit += label["share"][j] * (math.log(toxic / clean) if name in fires else math.log((1 - toxic) / (1 - clean)))
    x = [float(n in fires) for n in T.NAMES] + [math.log1p(hits), min(1.0, 50 * hits / len(w))]
    bag = Counter(k[0] >> 54 for k in keys)
    size = max(1.0, math.sqrt(sum(bag.values())))
    x += [math.sqrt(bag[b]) / size for b in range(T.BUCKETS)]
    z = sum(a * b for a, b in zip(x, model.weights.tolist())) + float(model.weights[-1])
    return fires, 1 / (1 + math.exp(-logit)), 1 / (1 + math.exp(-z))


def test_votes_and_scores_are_those_of_brute_force(spark, model):
    docs, _ = corpus(120, seed=9)
    docs += [(1000, "You idiot! you, IDIOT. Du Idiot"), (1001, "blödmann ist dumm; du"), (1002, ""), (1003, None), (1004, "..."), (1005, "zagroba " * 40 + "you"), (1006, "don't hate"), (1007, words(5, 20_000) + " scum"), (1008, "imbécile été ça")]
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = T.score(df, model).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, text in docs:
        fires, post, score = brute_score(text, model)
        votes, hits, _ = model.voters(T.tk.lower(T.tk.as_array(pa.array([text], pa.string()))))
        assert {n for n, v in zip(T.NAMES, votes[0]) if v} == fires, i
        assert by[i]["posterior"] == pytest.approx(post, abs=1e-9) and by[i]["score"] == pytest.approx(score, abs=1e-4), i
        assert by[i]["is_toxic"] == (by[i]["score"] >= 0.5)


def test_mining_is_that_of_brute_force(spark, model):
    docs, labels = corpus()
    toxic = dict(labels)
    bad, good = (sorted({t for i, t in docs if toxic[i] == y}) for y in (1, 0))

    def seen(texts):
        n = Counter()
        for t in texts:
            n.update({(size, x[:size] if size else x) for x in split(t) for size in (0, *T.BEGINNINGS) if len(x) >= size})
        return n

    in_bad, in_good = seen(bad), seen(good)
    least = max(4, math.ceil(0.015 * len(bad)))
    want = {k for k, n in in_bad.items() if n >= least and n / len(bad) >= 30 * (in_good[k] + 0.5) / len(good)}
    for size in (0, *T.BEGINNINGS):
        assert sorted(model.mined[size].tolist()) == sorted(hashed(x)[size] for s, x in want if s == size)


def test_hard_rows(hard, empty, model):
    rows = T.score(hard, model).collect()
    assert len(rows) == hard.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[102]["score"] == by[103]["score"] == by[104]["score"] == 0 and not by[104]["is_toxic"]
    assert len({(r["score"], r["is_toxic"]) for r in rows if r["doc_id"] == 3}) == 1
    out = T.drop_toxic(hard, model)
    assert out.columns == hard.columns and out.count() == hard.count()
    fresh = T.fit(empty)
    assert T.score(empty, fresh).collect() == [] and T.score(hard, fresh).count() == hard.count()
