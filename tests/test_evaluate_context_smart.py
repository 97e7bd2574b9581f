import json
import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, evaluate, smart, symbols


def one(spark, retrieved, relevant, column):
    row = spark.createDataFrame([(retrieved, relevant)], "r array<string>, rel array<string>").select(column(F.col("r"), F.col("rel"))).first()
    return row[0]


@pytest.mark.parametrize(
    "retrieved,relevant,k,want",
    [(["a", "b", "c"], ["a", "b"], 3, 1.0), (["a", "b", "c"], ["a", "b"], 1, 0.5), ([], ["a"], 5, 0.0), (["a"], [], 5, 1.0), (["x", "y", "a"], ["a"], 2, 0.0)],
)
def test_recall(spark, retrieved, relevant, k, want):
    assert one(spark, retrieved, relevant, lambda r, rel: evaluate.recall_at(r, rel, k)) == want


@pytest.mark.parametrize("retrieved,want", [(["a", "x"], 1.0), (["x", "a"], 0.5), (["x"], 0.0), ([], 0.0), (["x", "y", "a", "a"], 1 / 3)])
def test_reciprocal_rank(spark, retrieved, want):
    assert one(spark, retrieved, ["a"], evaluate.reciprocal_rank) == pytest.approx(want)


def test_ndcg(spark):
    at = lambda r, rel, **k: one(spark, r, rel, lambda x, y: evaluate.ndcg_at(x, y, 5, **k))
    assert at(["a", "x"], ["a", "b", "c"]) == 1.0  # the ideal orders what was found
    assert at(["a", "x"], ["a", "b", "c"], standard=True) == pytest.approx(1 / (1 + 1 / math.log2(3) + 0.5))
    assert at(["x", "a"], ["a"]) == pytest.approx(1 / math.log2(3)) and at(["x"], ["a"]) == 0.0 and at([], []) == 0.0


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert tuple(df.select(evaluate.nearest_rank("v", 0.5), evaluate.nearest_rank("v", 0.95)).first()) == (2.0, 4.0)


def traces(spark):
    rows = [("bm25", 1, "a", 1), ("vector", 1, "x", 1), ("rrf", 1, "a", 1), ("reranker", 1, "x", 1), ("final", 1, "x", 1), ("bm25", 2, "x", 1), ("vector", 2, "y", 1), ("rrf", 2, "x", 1), ("final", 2, "x", 1), ("final", 3, "c", 2)]
    return spark.createDataFrame(rows, "stage string, query_id long, chunk_id string, rank int"), spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "query_id long, relevant array<string>")


def test_stages_and_bad_cases(spark):
    t, rel = traces(spark)
    stages = {r["stage"]: r for r in evaluate.stage_metrics(t, rel).collect()}
    assert set(stages) == set(evaluate.STAGES) and stages["bm25"]["recall_at_5"] == pytest.approx(1 / 3) and stages["final"]["mrr"] == pytest.approx(1 / 3)
    bad = {(r["query_id"], r["category"]) for r in evaluate.bad_cases(t, rel).collect()}
    assert bad == {(1, "ranking_failure"), (1, "reranker_regression"), (2, "knowledge_gap")}


def test_summary(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (2, "x", 1)], "query_id long, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "query_id long, relevant array<string>")
    s = evaluate.summary(evaluate.per_query(ranked, rel, [1, 5]), [1, 5]).first()
    assert s["num_queries"] == 3 and s["num_zero_recall"] == 2 and s["mrr"] == pytest.approx(1 / 3)
    none = evaluate.summary(evaluate.per_query(ranked.limit(0), rel.limit(0), [1]), [1]).first()
    assert none["num_queries"] == 0 and none["mrr"] == 0.0


def test_passages_broadcast_and_not(spark):
    chunks = spark.createDataFrame([("a", "xx one two yy one two"), ("b", "one"), ("c", None), ("d", "two one two")], "chunk_id string, remarks string")
    asked = spark.createDataFrame([(1, "one two"), (2, "one"), (3, "zz"), (4, ""), (5, None), (6, "one two")], "query_id long, text string")
    want = {1: ["a", "d"], 2: ["a", "b", "d"], 6: ["a", "d"]}
    assert {r["query_id"]: r["relevant"] for r in evaluate.passages_in(chunks, asked).collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {r["query_id"]: r["relevant"] for r in evaluate.passages_in(chunks, asked).collect()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert evaluate.passages_in(chunks, asked.limit(0)).count() == 0


RESULT = "query_id long, chunk_id string, score double, type string, symbol_id string, signature string, source_label string, source_module string, source_file string, remarks string, example string, see_also array<string>"


def test_context(spark):
    rows = [(1, "a", 0.9, "function", "A::f", "int f()", "s1", "m1", "f.h", "Adds.", "f();", ["g"]), (1, "b", 0.5, "narrative", None, None, "s2", "", "p.html", "Prose.", None, None), (1, "c", 0.4, "narrative", "", "", "s1", "m1", "q.html", "More.", "", [])]
    q = spark.createDataFrame([(1, "how"), (2, "none")], "query_id long, query string")
    got = {r["query_id"]: r for r in context.build_context(spark.createDataFrame(rows, RESULT), q).collect()}
    text = got[1]["context"]
    assert got[1]["chunks"] == 3 and text.index("A::f") < text.index("More.") < text.index("Prose.") and text.count("## Source: s1") == 1
    assert "### [FUNCTION] A::f\n```cpp\nint f()\n```\n*Source: f.h | Score: 0.9000*\nAdds." in text and "*See also: g*" in text and "### [NARRATIVE] (narrative)" in text
    assert got[2]["chunks"] == 0 and "none" in got[2]["context"]
    small = context.build_context(spark.createDataFrame(rows, RESULT), q, 60).where("query_id = 1").first()
    assert "[...truncated]" in small["context"] and len(small["context"]) < len(text)


def test_names_in_payloads():
    value = {"hits": [{"symbol": "A::b", "x": {"qualified_name": "N::c"}}, {"name": "plain"}, {"name": "f", "kind": "function"}, {"name": "Search Results", "type": "x"}, "### Foo::bar (method)\ntext\n### Two words (class)\n### no\n"]}
    assert smart.names_in(value) == ["A::b", "N::c", "f", "Foo::bar", "Two words"]
    assert smart.names_in([]) == [] and smart.names_in({"symbol": "", "symbol_id": "s", "again": {"symbol_id": "s"}}) == ["s"]


def test_matching(spark):
    index = spark.createDataFrame([("A::f", "1"), ("f", "2"), ("Vec", "3")], "symbol_id string, chunk_id string")
    names = spark.createDataFrame([("A::f",), ("B::f",), ("Vec<int, Map<a>>",), ("f<T>",), ("g",), ("x.f",)], "name string")
    got = {r["name"]: r["symbol_id"] for r in symbols.match_api(names, index).collect()}
    assert got == {"A::f": "A::f", "Vec<int, Map<a>>": "Vec", "f<T>": "f"}
    shape = spark.createDataFrame([(" A<x>::b<y<z>>.c ",), ("",)], "s string").select(symbols.candidates(F.col("s"))).collect()
    assert shape[0][0] == ["A<x>::b<y<z>>.c", "A::b.c", "c"] and shape[1][0] == []


def test_smart_queries(spark):
    index = spark.createDataFrame([("A::f", "1"), ("Vec", "3")], "symbol_id string, chunk_id string")
    inner = json.dumps({"hits": [{"symbol": "Vec<int>"}, {"symbol": "A::f"}, {"symbol": "B::x"}]})
    text = json.dumps(dict(content=[dict(type="text", text=inner)]))
    usages = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "query_id long, payload string")
    matched, missing = smart.api_matches(usages, index)
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "query_id long, query string")
    got = {r["query_id"]: r["query"] for r in smart.doc_queries(q, matched).collect()}
    assert got == {1: "Vec A::f", 2: "two", 3: "three"} and [r["name"] for r in missing.collect()] == ["B::x"]
    assert all(r["degraded"] for r in smart.doc_queries(q, matched, available=False).collect())
