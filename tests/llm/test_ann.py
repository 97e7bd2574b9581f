import numpy as np

from lectern.llm import ann as A


def test_hilbert_keys_visit_neighbours():
    n = 16
    cells = np.array([(x, y) for x in range(n) for y in range(n)])
    order = cells[np.argsort(A.hilbert(cells, 4))]
    assert len(set(A.hilbert(cells, 4).tolist())) == n * n
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def brute(x, k):
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 32)), rng.normal(size=(20, 32)).repeat(40, axis=0) + 0.3 * rng.normal(size=(800, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = A.neighbours(df, block_bytes=64 * 4 * 32).collect()
    assert len(got) == 15_000
    true = {(i, int(j)) for i, row in enumerate(brute(x, 10)) for j in row}
    assert len(true & {(r["vec_id"], r["neighbour"]) for r in got}) >= 0.9 * len(true)
    for r in got[:50]:
        a, b = x[r["vec_id"]], x[r["neighbour"]]
        assert abs(r["cosine"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-4


def test_copies_come_first_and_by_id(spark):
    """Groups of equal and of parallel vectors, larger than any window: exact and in order."""
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(40)]
    rows = [(5000 - i, (x[0] * (1 + i % 3)).tolist()) for i in range(300)] + [(i, x[i % 40].tolist()) for i in range(1, 200)]
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_bytes=64 * 16 * 8).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour"], r["cosine"])
    assert set(got) == {i for i, _ in rows} and all(set(v) == set(range(1, 11)) for v in got.values())
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    cos = np.round(unit @ unit.T, 6)
    for a, (i, _) in enumerate(rows):
        want = sorted((-cos[a, b], j) for b, (j, _) in enumerate(rows) if b != a)[:10]
        same = [j for c, j in want if c == -1]
        assert [got[i][r][0] for r in range(1, len(same) + 1)] == same


def test_windows_cost_the_least():
    rng = np.random.default_rng(0)
    wide = rng.integers(1, 100_000, (2560, 32))
    curves, reach = A.plan_windows(wide, 100_000, 16_384, 0.95, 10)
    assert (wide[:, :curves].min(axis=1) <= reach).mean() >= 0.95
    near = np.ones((2560, 32), dtype=int)
    assert A.plan_windows(near, 100_000, 16_384, 0.95, 10) == (8, 11)
    assert A.plan_windows(np.zeros((0, 32), dtype=int), 1, 16_384, 0.95, 10)[1] == 1


def test_hard_rows(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(12)]
    rows += [(3, [0.0, 1.0, 3.0]), (50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (60, [1.0, 1.0, 1.0]), (61, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, curve string, place int")
    got = A.neighbours(df, k=3).collect()
    ids = {r["vec_id"] for r in got}
    assert ids == {*range(12), 60, 61} and len(got) == 3 * 14
    assert {(r["vec_id"], r["neighbour"]) for r in got if r["rank"] <= 2} >= {(60, 1), (61, 1), (60, 61), (61, 60)}
    assert A.neighbours(df.limit(0)).collect() == []
    assert A.neighbours(df.where("vec_id = 60")).collect() == []
