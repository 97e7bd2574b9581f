import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing as P
from tests.llm.conftest import words


def brute(size, inner, window, truncation, split):
    total = [0]
    for x in size:
        total.append(total[-1] + x)
    dp = [0.0] + [float("inf")] * len(size)
    for j in range(1, len(size) + 1):
        for i in range(j):
            x = total[j] - total[i]
            dp[j] = min(dp[j], dp[i] + (window - x if x <= window else truncation * (x - window)) + (split if inner[j - 1] else 0))
    return dp[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.booleans()), min_size=1, max_size=40), st.sampled_from([5, 16, 40]))
def test_cuts_cost_what_brute_force_costs(rows, window):
    size, inner = [r[0] for r in rows], [r[1] for r in rows]
    inner[-1] = False
    ends, cost = P.best_cuts(size, inner, window, 4.0, 3.0)
    assert abs(cost - brute(size, inner, window, 4.0, 3.0)) < 1e-9
    paid, a = 0.0, 0
    for b in ends:
        x = sum(size[a:b])
        paid += (window - x if x <= window else 4.0 * (x - window)) + (3.0 if inner[b - 1] else 0)
        a = b
    assert a == len(size) and abs(paid - cost) < 1e-9


def text(seed, n):
    return words(seed, n)


def test_windows_hold_all_tokens_in_order(spark):
    rng = random.Random(2)
    rows = [(i, text(i, rng.randint(1, 400))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 20, 2000):
        got = sorted(P.pack(df, window=64, shard_tokens=shard).collect(), key=lambda r: (r["shard"], r["window"]))
        again = sorted(P.pack(df.repartition(7), window=64, shard_tokens=shard).collect(), key=lambda r: (r["shard"], r["window"]))
        assert got == again
        last, lost = {}, 0
        order = []
        for w in got:
            assert w["n_tokens"] + w["padding"] == 64 and w["n_tokens"] == sum(b - a for a, b in zip(w["starts"], w["stops"]))
            lost += w["truncated"]
            for d, a, b in zip(w["doc_ids"], w["starts"], w["stops"]):
                assert a >= last.get(d, 0) and a < b
                last[d] = b
                order.append(d)
        assert order == sorted(order) and lost + sum(w["n_tokens"] for w in got) == sum(len(t.split()) for _, t in rows)


def test_one_shard_is_the_cheapest(spark):
    rows = [(i, text(50 + i, 20 + i)) for i in range(12)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=50, truncation=4.0, split=7.0).collect()
    size, inner = [], []
    for _, t in rows:
        s, n = [], 0
        for w in t.split():
            n += 1
            if w[-1] in ".!?":
                s.append(n)
                n = 0
        s += [n] if n else []
        size += s
        inner += [True] * (len(s) - 1) + [False]
    docs = {i: len(t.split()) for i, t in rows}
    cost = sum(w["padding"] + 4 * w["truncated"] + (7.0 if w["stops"][-1] + w["truncated"] < docs[w["doc_ids"][-1]] else 0) for w in got)
    assert cost == brute(size, inner, 50, 4.0, 7.0)


def test_long_sentences_are_cut_inside(spark):
    rows = [(1, text(1, 40)), (2, "same " * 3000), (3, text(3, 90)), (4, "word " * 64 * 5), (5, "tail " * 130)]
    got = sorted(P.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64).collect(), key=lambda r: r["window"])
    held = {d: 0 for d, _ in rows}
    for w in got:
        for d, a, b in zip(w["doc_ids"], w["starts"], w["stops"]):
            held[d] += b - a
    assert all(held[d] > len(t.split()) - 64 for d, t in rows) and max(w["truncated"] for w in got) < 64
    size, at = P._within(*P.sentences(P.pa.array(["a b c d e f g", "", "h. i j"], P.pa.large_string())), 3)
    assert size.tolist() == [3, 3, 1, 1, 2] and at.tolist() == [0, 3, 3, 5]


def test_hard_rows(hard, empty):
    got = P.pack(hard, window=128).collect()
    ids = [d for w in got for d in w["doc_ids"]]
    assert not {102, 103, 104} & set(ids) and None not in ids and {3, 5, 105, 106, 107} <= set(ids)
    assert P.pack(empty).collect() == []
    tokens = [r[0] for r in hard.where("doc_id is not null and text is not null").selectExpr("regexp_count(text, '\\\\S+')").collect()]
    assert sum(w["n_tokens"] + w["truncated"] for w in got) == sum(tokens)


def test_a_vocabulary_file_counts_tokens(spark):
    try:
        import public_tokenizers
    except ImportError:
        return
    df = spark.createDataFrame([(1, "Hello there, friend. Once more!"), (2, "Über")], "doc_id long, text string")
    got = P.pack(df, window=8, tokenizer=public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sum(w["n_tokens"] + w["truncated"] for w in got) >= 8
