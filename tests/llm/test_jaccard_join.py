import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import jaccard_join as J
from tests.llm.conftest import SCHEMA, hard_rows, words


def grams(text, n=3):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.5):
    sets = {}
    for i, t, *_ in rows:
        if i is not None and t and grams(t):
            sets.setdefault(i, grams(t))
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold:
            out[a, b] = j
    return out


def brute_classes(rows, threshold=0.5):
    """(doc_id, class_id, links) of every id."""
    pairs, ids = brute(rows, threshold), {r[0] for r in rows} - {None}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    links = Counter(i for p in pairs for i in p)
    return sorted((i, top(i), links[i]) for i in ids)


def joined(df):
    out = J.ngram_jaccard_join(df)
    assert out.columns == ["doc_id", "class_id", "links"]
    return sorted(tuple(r) for r in out.collect())


def rows_with_copies():
    rows = [(i, words(i, 60 + i)) for i in range(30)]
    for i in range(10):
        w = words(i, 60 + i).split()
        w[5] = "changed"
        w[40] = "other"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(3, 63)) for i in range(40)]  # a hot group of equal texts
    return [(*r, "en", "s", 0, "k", "id", "row", 1) for r in rows]


def test_classes_and_links_are_those_of_brute_force(spark):
    rows = rows_with_copies()
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute_classes(rows)


def near_copies(n=400):
    """n near copies of one text, each linked to all, in a class with a copy of a copy and a chain's end; boilerplate that isn't linked; a text of an id that only another row of that id would link."""
    base, plate = words(5, 120).split(), words(6, 25)
    rows = []
    for i in range(n):
        w = list(base)
        w[i % 120] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(900, rows[7][1]), (901, rows[7][1] + " " + words(8, 60))]
    rows += [(2000 + i, f"{plate} {words(3000 + i, 40)}") for i in range(150)]
    left, right = words(9, 60), words(10, 60)
    rows += [(3000, left), (3001, right), (3002, words(11, 70)), (3002, f"{left} {right}")]
    return [(*r, "en", "s", 0, "k", "id", "row", 1) for r in rows]


def test_a_row_a_document_however_many_links(spark, monkeypatch):
    """The rows don't grow with a cluster's pairs, nor do pairs that are checked; tiles lose nothing."""
    rows, compared = near_copies(), []
    checked = J._checked
    monkeypatch.setattr(J, "_checked", lambda docs, nodes, pairs, *a: (compared.append(pairs.count()), checked(docs, nodes, pairs, *a))[1])
    one = next(r for r in J.signatures(spark.createDataFrame([r for r in rows if r[0] == 3002], SCHEMA), 3, "doc_id", "text").orderBy("k").select("t").collect())[0]
    of = spark.createDataFrame(rows, SCHEMA)
    kept = {r[0] for r in of.selectExpr("text", "xxhash64(text) t").where(f"t = {one}").collect()}
    want = brute_classes([r for r in rows if r[0] != 3002 or r[1] in kept])
    assert joined(of) == want and max(r[2] for r in want) > 390
    assert sum(compared) < 20 * len(rows)
    for name, value in (("TILE", 60), ("SMALL", 4), ("NODES_A_TILE", 50), ("BYTES_A_TILE", 20_000)):
        monkeypatch.setattr(J, name, value)
    assert joined(of) == want


def test_broken_ties_are_compared_in_full(spark, monkeypatch):
    """Ties that the exact check breaks don't cost a link."""
    monkeypatch.setattr(J, "SURE", 0.0011)
    monkeypatch.setattr(J, "SMALL", 4)
    rows = []
    for c in range(3):
        w = words(c, 90).split()
        for step in range(40):
            w[(7 * step) % 90] = f"new{c}x{step}"
            rows.append((c * 100 + (17 * step) % 40, " ".join(w), "en", "s", 0, "k", "id", "row", 1))
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute_classes(rows)


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(1)
    for m, k, v in ((1, 1, 3), (60, 50, 300), (300, 200, 5000)):
        a, b = ([np.unique(rng.zipf(1.3, rng.integers(1, 60)).clip(0, v).astype(np.uint64)) for _ in range(x)] for x in (m, k))
        assert (J._overlap(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_hard_rows(hard):
    got = joined(hard)
    want = brute_classes([r for r in hard_rows() if r[0] != 5])
    assert [r for r in got if r[0] != 5] == want
    assert dict((r[0], r[1:]) for r in got)[100] == (4, 2) and len(got) == len({r[0] for r in hard_rows()} - {None})


def test_empty(empty):
    assert J.ngram_jaccard_join(empty).collect() == []
    assert J.drop_near_duplicates(empty).collect() == []


def brute_kept(rows, threshold=0.5):
    """Rows that stay: of each connected group of rows with an id and words the one of smallest id; all others."""
    live = [i for i, r in enumerate(rows) if r[0] is not None and r[1] and grams(r[1])]
    root = {i: i for i in live}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(live, 2):
        x, y = grams(rows[a][1]), grams(rows[b][1])
        if len(x & y) >= threshold * len(x | y):
            root[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for i in live:
        groups.setdefault(top(i), []).append(i)
    return [rows[i] for i in range(len(rows)) if i not in root], list(groups.values())


def assert_kept(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = J.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    others, groups = brute_kept(rows)
    assert len(got) == len(others) + len(groups)
    left = list(got)
    for r in others:
        left.remove(r)  # each as often as it was there
    for g in groups:
        mine = [r for r in left if r in [rows[i] for i in g]]
        assert len(mine) == 1 and mine[0][0] == min(rows[i][0] for i in g)


def test_shared_ids_lose_nothing(spark):
    extra = ("en", "s", 0, "k", "id", "row", 1)
    t, u = words(1, 100), words(2, 100)
    rows = [(1, t), (7, t), (7, ""), (7, None), (8, t), (8, u), (8, u + " "), (9, words(3, 100)), (None, t), (None, t), (8, u)]
    assert_kept(spark, [(*r, *extra) for r in rows] + [(400 + r[0], *r[1:]) for r in rows_with_copies()])


def test_one_of_each_group_stays(spark):
    assert_kept(spark, hard_rows())


def shuffled(spark, action):
    """The action's result, and the bytes it shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(k) for k in range(found.size()))}

    before = stages()
    out = action()
    return out, sum(v for k, v in stages().items() if k not in before)


def test_texts_that_have_no_copies_stay_where_they_are(spark):
    """Also where no side of a join is small enough to be broadcast."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 2500))) for i in range(300)]
    rows += [(900 + i, rows[i][1] + " tail") for i in range(5)] + [rows[9]]
    df = spark.createDataFrame([(*r, "en", "s", 0, "k", "id", "row", 1) for r in rows], SCHEMA).repartition(3).cache()
    df.count()
    limit, name = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        kept, moved = shuffled(spark, lambda: sorted(r[0] for r in J.drop_near_duplicates(df).collect()))
    finally:
        spark.conf.set(name, limit)
        df.unpersist()
    assert kept == list(range(300))
    assert moved < 0.5 * sum(len(r[1]) for r in rows)


def test_bitmap_of_keys(spark, monkeypatch):
    """All keys pass, few others; one that is full lets all pass and costs no row."""
    keys = spark.range(20_000).selectExpr("id", "7 - id t").localCheckpoint()
    others = spark.range(20_000, 60_000).selectExpr("id", "7 - id t")
    passed = lambda df: df.where(J._among(keys)(F.col("id"), F.col("t"))).count()
    assert passed(keys) == 20_000 and 0 < passed(others) < 2000
    assert keys.where(J._among(keys.limit(0))(F.col("id"), F.col("t"))).isEmpty()
    monkeypatch.setattr(J, "MOST_BITS", 8)
    assert passed(keys) == 20_000 and passed(others) == 40_000
    assert_kept(spark, hard_rows())
    assert joined(spark.createDataFrame(rows_with_copies(), SCHEMA)) == brute_classes(rows_with_copies())


def test_chains_and_mixed_bands(spark):
    """Copies of copies, which hang together only by steps, beside clusters about as near as the threshold."""
    rows, k = [], 0
    for c in range(6):
        w = words(c // 2, 90).split()  # two clusters each from one text
        for step in range(25):
            w[(7 * step + 31 * (c % 2)) % 90] = f"new{c}x{step}"
            rows.append((1000 - k, " ".join(w), "en", "s", 0, "k", "id", "row", 1))
            k += 1
    assert_kept(spark, rows)


def test_stage_is_linear_in_a_cluster(spark):
    """Of n near copies about n pairs are compared, not n * n / 2."""
    base = words(5, 120).split()
    rows = []
    for i in range(800):
        w = list(base)
        w[i % 120] = f"other{i}"
        rows.append((i, " ".join(w), "en", "s", 0, "k", "id", "row", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    table, nodes = J._nodes(docs, 3, "doc_id", "text")
    compared = []

    def check(pairs):
        compared.append(pairs.count())
        return J._checked(docs, nodes, pairs, 3, 0.5, 0.001, "doc_id", "text")

    assert J.linked_nodes(nodes, check).select("root").distinct().count() == 1
    assert sum(compared) < 10 * len(rows) * 3  # a node has some centres, one for each of its bands at most


def test_blocks_are_bounded_by_bytes_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_A_BLOCK", 50)
    monkeypatch.setattr(J, "BYTES_A_BLOCK", 20_000)
    rows = rows_with_copies() + [(1000 + i, words(3, 63) + f" x{i}", "en", "s", 0, "k", "id", "row", 1) for i in range(40)]
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute_classes(rows)


def test_pruning_keeps_what_the_posterior_allows():
    need = J.min_matches(0.5, 0.001)
    assert need[32] < 16 and need[160] > need[32]
    rng = np.random.default_rng(0)
    for n, m in need.items():
        s = rng.beta(m + 1, n - m + 1, 200_000)
        assert (s >= 0.5).mean() >= 0.0003
        s = rng.beta(m, n - m + 2, 200_000)
        assert (s >= 0.5).mean() <= 0.002


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 5))
def test_gram_hashes_stand_for_grams(numbers, n):
    import pyarrow as pa

    from lectern.llm import textkit as tk

    text = " ".join(f"v{x}" for x in numbers)
    data, off = tk.raw(tk.as_array(pa.array([text, "", text])))
    s, e, first = tk.words(data, off)
    g, at = tk.gram_hashes(tk.word_hashes(data, s, e), first, n)
    assert list(np.diff(at)) == [max(1, len(numbers) - n + 1), 0, max(1, len(numbers) - n + 1)]
    assert (g[: at[1]] == g[at[2] :]).all()
    assert len(set(g.tolist())) == len(grams(text, n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)]
    got = {r["id"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[102] == 100
