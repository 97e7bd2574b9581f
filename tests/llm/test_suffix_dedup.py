import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import suffix_dedup as S
from tests.llm.conftest import SCHEMA, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80))
def test_suffix_array_sorts_suffixes(symbols):
    got = S.suffix_array(np.array(symbols, dtype=np.int64), 100).tolist()
    assert got == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_min(x, w):
    x = np.array(x)
    assert S.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def brute(rows, length=50):
    seen, marks = {}, {}
    for i, _, t in sorted({(i, str(t), t) for i, t in rows}):
        w = t.split()
        for k in range(len(w) - length + 1):
            first = seen.setdefault(tuple(w[k : k + length]), (i, k))
            if first != (i, k):
                marks[i, k] = first
    out, cur = set(), None
    for (i, k), (f, p) in sorted(marks.items()):
        if cur and (i, k, f, p) == (cur[0], cur[2], cur[3], cur[5]):
            cur[2], cur[5] = k + 1, p + 1
        else:
            if cur:
                out.add((cur[0], cur[1], cur[2] + length - 1, cur[3], cur[4]))
            cur = [i, k, k + 1, f, p, p + 1]
    if cur:
        out.add((cur[0], cur[1], cur[2] + length - 1, cur[3], cur[4]))
    return out


def planted():
    passage, long = words(900, 55), words(901, 300)
    rows = [(i, words(i, 100)) for i in range(12)]
    rows += [(20, words(20, 30) + " " + passage + " " + words(21, 40)), (21, passage), (22, words(22, 90) + "\n" + passage)]
    rows += [(23, long), (24, words(24, 10) + " " + long), (25, long[: len(long) // 2]), (26, long + " " + words(26, 60) + " " + long)]
    rows += [(30, "same " * 200), (31, "a b c " * 70), (32, words(902, 49)), (33, words(902, 49)), (34, words(903, 50)), (35, words(903, 50))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1]), "k", "id", "row", 1) for r in rows], SCHEMA)


def test_passages_are_those_of_brute_force(spark):
    rows = planted()
    got = [tuple(r) for r in S.repeated_passages(frame(spark, rows)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def boilerplate():
    """A passage of 20 words, which often has the minimiser, in many contexts, some of which repeat."""
    plate, rows = words(950, 20), []
    for i in range(100):
        body = f"{words(2000 + i % 90, 60)} {plate} {words(3000 + i % 80, 60)}"
        rows.append((i, f"{words(4000 + i, 5)} {body}" if i % 2 else body))
    return rows + [(400, words(1, 40) + (" " + plate) * 30), (401, words(2, 41) + (" " + plate) * 25)]


def test_split_minimisers_change_nothing(spark):
    """With room for few words every minimiser is split again and again."""
    rows = planted() + boilerplate()
    rows = [(i if k < len(planted()) else 500 + i, t) for k, (i, t) in enumerate(rows)]
    want = brute(rows)
    for hot in (S.HOT_WORDS, 400):
        got = [tuple(r) for r in S.repeated_passages(frame(spark, rows), hot_words=hot).collect()]
        assert set(got) == want and len(got) == len(want), hot


def test_a_hot_minimiser_is_spread():
    """One run of words in 100,000 contexts: its windows go to many other minimisers."""
    rng = np.random.default_rng(1)
    plate = rng.integers(0, 1 << 32, 16, dtype=np.uint64).astype(np.uint32)
    contexts = rng.integers(0, 1 << 32, (100_000, 68), dtype=np.uint64).astype(np.uint32)
    snippets = [np.concatenate([c[:34], plate, c[34:]]) for c in contexts]
    row, lo, hi, key = S.resplit(snippets, 50, 16, 1)
    assert (hi - lo).sum() == sum(len(s) - 49 for s in snippets) and (lo >= 0).all()
    _, many = np.unique(key, return_counts=True)
    assert many.max() <= len(snippets) and many.max() < 0.25 * len(key) and len(many) > 100_000


def test_cutting_leaves_first_occurrences(spark):
    rows = planted()
    df = frame(spark, rows)
    out = {r["doc_id"]: r for r in S.cut_repeats(df).collect()}
    assert out[20]["text"] == dict(rows)[20] and 21 not in out and 35 not in out and out[34]["text"] == dict(rows)[34]
    assert out[22]["text"] == words(22, 90) and out[22]["n_chars"] == len(out[22]["text"])
    assert out[33]["text"] == dict(rows)[33]  # 49 words are too few
    assert S.cut_repeats(df).columns == df.columns
    again = [(i, r["text"]) for i, r in out.items()]
    assert all(end - start >= 50 for _, start, end, _, _ in brute(again)) or not brute(again)


def test_hard_rows(hard, empty):
    got = S.repeated_passages(hard).collect()
    assert {r["doc_id"] for r in got} >= {100, 101, 107} and not {r["doc_id"] for r in got} & {3, 102, 103, 104, 105}
    out = S.cut_repeats(hard)
    assert out.columns == hard.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(3) == 3 and 100 not in ids and None in ids and 104 in ids
    assert S.repeated_passages(empty).collect() == [] and S.cut_repeats(empty).collect() == []
