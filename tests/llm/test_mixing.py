import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import mixing as M
from tests.llm.conftest import words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.01, 0.3, 1.0, 2.5]), st.integers(0, 1000)), min_size=1, max_size=8), st.floats(0, 1))
def test_water_fill(children, share):
    able = sum(c for w, c in children if w > 0)
    got = M.water_fill(able * share, [(w, float(c)) for w, c in children])
    assert abs(sum(got) - able * share) < 1e-6 * max(1, able)
    assert all(-1e-9 <= g <= c + 1e-9 and (w > 0 or g == 0) for g, (w, c) in zip(got, children))
    open_ = [g / w for g, (w, c) in zip(got, children) if w > 0 and g < c - 1e-6]
    full = [c / w for g, (w, c) in zip(got, children) if w > 0 and c and g >= c - 1e-6]
    assert not open_ or max(open_) - min(open_) < 1e-6 * max(1, max(open_))  # who isn't full has the same level
    assert not open_ or all(f <= max(open_) + 1e-6 * max(1, f) for f in full)


def test_siblings_take_a_shortage_before_ancestors():
    mix = M.Mix(levels=("a", "b"), names=("a", "b"), weights={("x",): 0.5, ("y",): 0.5}, budget=0.5, max_epochs=1)
    quota = M.allocate({("x", "p"): 10, ("x", "q"): 990, ("y", "r"): 1000}, mix)
    assert quota == {("x", "p"): 10, ("x", "q"): 490, ("y", "r"): 500}
    quota = M.allocate({("x", "p"): 10, ("x", "q"): 90, ("y", "r"): 1900}, mix)
    assert quota == {("x", "p"): 10, ("x", "q"): 90, ("y", "r"): 900}


SPEC = M.Mix(levels=("lang", "source"), names=("lang", "source"), weights={("en",): 0.7, ("de",): 0.3}, budget=0.9, max_epochs=3)


def brute(rows, spec):
    leaves = {}
    for i, t, lang, src in rows:
        leaves.setdefault((lang, src), []).append((i, len(t.split())))
    quota = M.allocate({p: sum(n for _, n in d) for p, d in leaves.items()}, spec)
    out = []
    for p, docs in leaves.items():
        total = sum(n for _, n in docs)
        full, rest = divmod(quota[p], total)
        out += [(i, e) for e in range(full) for i, _ in docs]
        seen = 0
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"{spec.seed}:{full}:{d[0]}".encode()).hexdigest()):
            seen += n
            if seen > rest:
                break
            out.append((i, full))
    return sorted(out)


def test_selection_is_that_of_brute_force(spark):
    rows = [(i, words(i, 5 + i % 50), "en" if i % 3 else "de", f"s{i % 4}" if i % 3 else "s9") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r["doc_id"], r["epoch"]) for r in M.mix(df, SPEC).collect()) == brute(rows, SPEC)
    full = M.mix_rows(df, SPEC)
    assert full.columns == df.columns and sorted(r["doc_id"] for r in full.collect()) == [i for i, _ in brute(rows, SPEC)]


def test_hard_rows(hard, empty):
    got = M.mix(hard).collect()
    assert got and len({(r["doc_id"], r["epoch"]) for r in got if r["doc_id"] == 3}) * 3 == sum(r["doc_id"] == 3 for r in got)
    assert M.mix_rows(hard).columns == hard.columns
    assert M.mix(empty).collect() == [] and M.mix_rows(empty).collect() == []


def test_any_source_name(spark):
    names = ["web", "", None, "s99999999999", "s12345678901234567890", "src7", "a-3-b", "ü"]
    rows = [(i, words(i, 20), [None, "en", "de"][i % 3], names[i % len(names)]) for i in range(160)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.mix(df).collect()
    assert out and {r["source"] for r in out} <= {n or "" for n in names}
    domains = {r["source"]: r["domain"] for r in out}
    assert domains["web"] == domains[""] == domains["ü"] == domains["s12345678901234567890"] == "other"
    assert domains["s99999999999"] == "d3" and domains["src7"] == domains["a-3-b"] == "d3"
    assert sum(r["n_tokens"] for r in out) <= 20 * 160
    assert sorted(r["doc_id"] for r in M.mix_rows(df).where("doc_id is not null").collect()) == sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
