import hashlib
import itertools
import re

import corpus_pipeline
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lectern.llm import mixing, packing, toxicity
from tests.llm.conftest import words
from tests.llm.test_jaccard_join import brute_kept
from tests.llm.test_packing import brute as packing_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute
from tests.llm.test_toxicity import brute_score

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


#: the table that an operator reads, and whether its query has exactly one row for each of the table's rows
TABLES = {"op1": ("documents", True), "op2": ("documents", True), "op3": ("documents", True), "op4": ("documents", False), "op5": ("documents", False), "op6": ("documents", False), "op7": ("embeddings", False), "op8": ("documents", True), "op9": ("pages", True), "op10": ("documents", False)}


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_queries_read_their_whole_table(spark, name):
    table, whole = TABLES[name.split("_")[0]]
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    got = entry.queries()[name](spark, SF).collect()
    key = rows.columns[0]
    ids = {r[0] for r in rows.select(key).collect()}
    if whole:
        assert sorted(r[key] for r in got) == sorted(ids)
    elif name.startswith("op7"):
        assert len(got) == 10 * len(ids) and {r[key] for r in got} == ids
    elif name.startswith("op4"):
        assert {d for r in got for d in r["doc_ids"]} == {r[0] for r in rows.where("trim(text) <> ''").select(key).collect()}
    elif name.startswith("op6"):
        words_of = rows.selectExpr("sum(regexp_count(text, '[^ \\t\\n\\x0B\\f\\r]+'))").first()[0]
        assert {r[key] for r in got} <= ids and 0.9 * words_of <= sum(r["n_tokens"] for r in got) <= words_of
    else:
        assert {r[key] for r in got} <= ids


def test_pipeline_over_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def corpus():
    """Documents with toxic ones, copies, near copies and passages in common, and their labels."""
    docs, labels = [], []
    for i in range(160):
        w = words(100 + i, 40 + i % 70).split()
        if i % 8 == 0:
            for k in range(4):
                w.insert(7 * k, ["idiot", "scum", "pathetic", "moron"][(i // 8 + k) % 4])
        docs.append((i, " ".join(w), ["en", "de", "fr", None][i % 4], ["src0", "src1", "web", "src7", None][i % 5], 0))
        labels.append((i, int(i % 8 == 0)))
    plate = words(9999, 60)
    for i in range(1, 160, 10):
        w = docs[i][1].split()
        w[len(w) // 2] = "changed"
        docs += [(1000 + i, " ".join(w), "en", "src2", 0), (2000 + i, docs[i][1], "en", "src2", 0)]
        docs.append((3000 + i, f"{words(5000 + i, 150)} {plate} {words(6000 + i, 110)}", "es", f"src{i % 6}", 0))
    docs += [(4000, "", "en", "src1", 0), (4001, plate, "en", "src1", 0), (4002, words(7000, 3000), "en", "src3", 0)]
    return [(*d[:4], len(d[1])) for d in docs], labels


def cut_brute(rows):
    spans = {}
    for i, a, b, _, _ in suffix_brute([(r[0], r[1]) for r in rows]):
        spans.setdefault(i, set()).update(range(a, b))
    out = []
    for r in rows:
        if r[0] in spans:
            at = [m.span() for m in re.finditer(r"\S+", r[1])]
            left = [k for k in range(len(at)) if k not in spans[r[0]]]
            runs = [list(g) for _, g in itertools.groupby(left, key=lambda k: k - left.index(k))]
            text = "\n".join(r[1][at[g[0]][0] : at[g[-1]][1]] for g in runs)
            if not left:
                continue
            r = (r[0], text, *r[2:4], len(text))
        out.append(r)
    return out


def mix_brute(rows):
    spec, leaves = mixing.Mix(), {}
    for r in rows:
        number = re.search("[0-9]+", r[3] or "")
        leaves.setdefault((f"d{int(number.group()) % 4}" if number else "other", r[2] or "", r[3] or ""), []).append((r, len(r[1].split())))
    quota = mixing.allocate({p: sum(n for _, n in d) for p, d in leaves.items()}, spec)
    out = []
    for path, held in leaves.items():
        total = sum(n for _, n in held)
        full, rest = divmod(quota[path], total) if total else (0, 0)
        out += [r for r, _ in held] * full
        for r, n in sorted(held, key=lambda d: hashlib.md5(f"{spec.seed}:{full}:{d[0][0]}".encode()).hexdigest()):
            rest -= n
            if rest < 0 or not total:
                break
            out.append(r)
    return out


def test_rows_of_every_stage_are_those_of_brute_force(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    got, given = [], rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        got = [tuple(r) for r in docs.collect()]
        order = lambda x: sorted(x, key=str)
        if k == 0:
            assert order(got) == order(r for r in given if brute_score(r[1], model)[2] < 0.5)
            assert {r[0] for r in given} - {r[0] for r in got} == {i for i, y in labels if y}
        elif k == 1:
            others, groups = brute_kept(given)
            assert order(got) == order(others + [min((given[i] for i in g), key=lambda r: r[0]) for g in groups]) and len(got) < len(given)
        elif k == 2:
            assert order(got) == order(cut_brute(given)) and any(a[1] != b[1] for a, b in zip(order(got), order(given)))
        elif k == 3:
            assert order(got) == order(mix_brute(given))
        given = got if k < 4 else given
    size, inner = [], []
    for r in sorted(given, key=lambda r: r[0]):
        s, _ = packing._within(*packing.sentences(pa.array([r[1]], pa.large_string())), 2048)
        size += s.tolist()
        inner += [True] * (len(s) - 1) + [False] * bool(len(s))
    words_in = {}
    for r in given:
        words_in.setdefault(r[0], []).append(len(r[1].split()))
    windows = [r.asDict() for r in docs.collect()]
    assert sum(w["n_tokens"] + w["truncated"] for w in windows) == sum(map(sum, words_in.values()))
    paid = sum(w["padding"] + 4.0 * w["truncated"] + (32.0 if w["stops"][-1] + w["truncated"] < words_in[w["doc_ids"][-1]][0] else 0) for w in windows)
    assert paid == packing_brute(size, inner, 2048, 4.0, 32.0)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_stages_keep_clashing_columns_out(spark, hard, tmp_path):
    """Columns beside those of documents, with names that operators use inside, go through every stage."""
    docs = hard
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == hard.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0
