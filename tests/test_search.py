import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators import bm25, fusion, rewrite, vector
from lectern.plans import hybrid

CHUNK = "chunk_id string, type string, symbol_id string, signature string, remarks string, example string, references array<string>, contains_code boolean, source_label string, source_module string, collection string, embed_text string"


def chunk(i, text, kind="narrative", symbol="", refs=(), code=False, module="core", label="t"):
    return (i, kind, symbol, "", text, "", list(refs), code, label, module, f"{label}.{module}", text)


DOCS = [
    chunk("a", "open the file and read the file", symbol="File::open", refs=["File::close", "Nope", "File::read"]),
    chunk("b", "close the file", "function", "File::close"), chunk("c", "the and the and the"), chunk("d", "draw a line with code", code=True, module="gui"),
    chunk("e", "read bytes of a file", "function", "File::read"), chunk("f", "", "class", "File"), chunk("g", "a line and a file", module="gui"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(DOCS, CHUNK).cache()


@pytest.fixture(scope="module")
def ask(spark):
    return lambda *qs: spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def okapi(docs, query):
    """Scores of one field of one collection, as the formula says."""
    words = {i: t.lower().split() for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    return {i: sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for q in query.lower().split()) for i, ws in words.items()}


def test_bm25_is_the_formula(chunks, ask):
    for q in ("the file", "file file read", "THE and code", "unknown"):
        want = Counter()
        for c in {d[10] for d in DOCS}:
            inside = [d for d in DOCS if d[10] == c]
            for i, s in okapi({d[0]: d[11] for d in inside}, q).items():
                want[i] += s
            if any(d[2] for d in inside):
                for i, s in okapi({d[0]: d[2] for d in inside}, q).items():
                    want[i] += 10 * s
        got = {r["chunk_id"]: r["score"] for r in bm25.scores(bm25.build_index(chunks), ask(q)).collect()}
        assert got == pytest.approx({i: s for i, s in want.items() if s > 0})


def test_bm25_limits(chunks, ask):
    postings = bm25.build_index(chunks)
    assert bm25.search(postings, ask("  ", ""), 5).count() == 0
    rows = bm25.search(postings, ask("file", "close read"), 2).collect()
    assert max(r["rank"] for r in rows) == 2 and {r["query_id"] for r in rows} == {0, 1}
    assert bm25.search(postings, ask("close"), 9).count() == 1 and bm25.search(postings, ask("close"), 9, collections=["t.gui"]).count() == 0
    full = bm25.build_index(chunks.withColumn("example", F.lit("zebra")), full_fields=True)
    assert bm25.search(full, ask("zebra"), 9).count() == 0


def test_tokenizer_knows_unicode_space(spark):
    from lectern.functions.text import tokenize

    text = "Ein Wort ZWEI　drei\u0085vier\x1cfünf, sechs"
    got = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0]
    assert got == text.lower().split()


def test_knn_is_that_of_brute_force(spark):
    """Broadcast and product, queries of two lengths, ties."""
    stored = [(f"v{i:02}", [float(i % 17), 1.0]) for i in range(40)] + [(f"w{i}", [1.0, float(i), 2.0]) for i in range(9)] + [("n", None), ("e", []), ("z", [0.0, 0.0])]
    given = [(1, [3.2, 1.0]), (2, None), (3, [0.5, 2.0, 2.0]), (4, []), (5, [16.0, -1.0]), (6, [1.0, 1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(stored, "chunk_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(given, "query_id long, embedding array<float>").repartition(2)

    def score(x, y, metric):
        x, y = [float(np.float32(v)) for v in x], [float(np.float32(v)) for v in y]
        if metric == "l2sq":
            return round(1 - sum((a - b) ** 2 for a, b in zip(x, y)), 6)
        size = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return round(sum(a * b for a, b in zip(x, y)) / size, 6) if size else None

    for metric in ("l2sq", "cosine"):
        want = []
        for i, x in given:
            found = sorted((-s, c) for c, y in stored if x and y and len(x) == len(y) and (s := score(x, y, metric)) is not None)
            want += [(i, c, pytest.approx(-s, abs=2e-6), r) for r, (s, c) in enumerate(found[:4], 1)]
        for limit in ("10MB", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = [(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in vector.knn(rows, q, 4, metric).collect()]
            assert len(got) == len(want) and sorted((g[0], g[3], g[1]) for g in got) == sorted((w[0], w[3], w[1]) for w in want)
            assert all(any(g[:2] == w[:2] and g[2] == w[2] for w in want) for g in got)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_known_fusion(spark):
    v = ranked(spark, [(0, "a", 0.9, 1), (0, "b", 0.8, 2)])
    k = ranked(spark, [(0, "a", 5.0, 1)])
    got = {r["chunk_id"]: r["score"] for r in fusion.reciprocal_ranks(v, k).collect()}
    assert got == pytest.approx({"a": 0.0967741935, "b": 0.03125})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), unique=True, max_size=6), st.lists(st.sampled_from("abcdefgh"), unique=True, max_size=6))
def test_fusion_is_symmetric_at_equal_weight(spark, x, y):
    one, two = (ranked(spark, [(0, c, 1.0, i + 1) for i, c in enumerate(z)]) for z in (x, y))
    a = {r["chunk_id"]: r["score"] for r in fusion.reciprocal_ranks(one, two, keyword_weight=1.0).collect()}
    b = {r["chunk_id"]: r["score"] for r in fusion.reciprocal_ranks(two, one, keyword_weight=1.0).collect()}
    assert a == pytest.approx(b) and set(a) == {*x, *y}


def test_candidates_prefer_api_types(spark):
    rows = spark.createDataFrame([(0, c, 1.0 - i / 10, i + 1, t) for i, (c, t) in enumerate([("n1", "narrative"), ("n2", "pdf_section"), ("f1", "function"), ("n3", "narrative"), ("e1", "enum")])], "query_id long, chunk_id string, score double, rank int, type string")
    got = sorted(fusion.rerank_candidates(rows, 3).collect(), key=lambda r: r["rank"])
    assert [r["chunk_id"] for r in got] == ["n1", "f1", "e1"] and fusion.rerank_candidates(rows, 0).count() == 5


def test_rerank_decision(spark, ask):
    fused = ranked(spark, [(0, "a", 0.5, 1), (0, "b", 0.2, 2), (1, "a", 0.3, 1), (1, "b", 0.2, 2), (2, "a", 0.3, 1), (3, "a", 0.9, 1)])
    got = {r["query_id"]: r["rerank"] for r in fusion.rerank_decision(ask("how to x", "how to y", "Foo::bar", "one hit here"), fused).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True}


def test_reference_expansion(spark, chunks):
    rows = ranked(spark, [(0, "a", 1.0, 1), (0, "b", 0.5, 2)])
    got = sorted(fusion.expand_references(rows, chunks).collect(), key=lambda r: r["rank"])
    assert [(r["chunk_id"], r["rank"]) for r in got] == [("a", 1), ("b", 2), ("e", 3)] and got[2]["score"] == pytest.approx(0.8)
    assert fusion.expand_references(rows, chunks, limit=0).count() == 2


def test_module_filter_comes_after(spark, chunks):
    rows = ranked(spark, [(0, "a", 1.0, 1), (0, "d", 0.5, 2), (0, "g", 0.4, 3)])
    got = sorted(fusion.module_filter(rows, chunks, "gui").collect(), key=lambda r: r["rank"])
    assert [(r["chunk_id"], r["rank"]) for r in got] == [("d", 1), ("g", 2)] and fusion.module_filter(rows, chunks, None) is rows


def test_known_variants(ask):
    q = "how to set up setup get"
    got = [r["query"] for r in sorted(rewrite.variant_queries(ask(q, "Foo::get set", "get", "", "nothing here")).where("query_id = 0").collect(), key=lambda r: r["nth"])]
    assert got == [q, "how to set up initialize get", "how to set up configure get", "how to set up setup retrieve"]
    assert rewrite.variant_queries(ask("Foo::get set", "get", "", "nothing here")).count() == 4


def test_hybrid_end_to_end(spark, chunks, ask):
    embed = vector.hashing_embedder(32)
    vectors = chunks.select("chunk_id", embed("embed_text").alias("embedding"))
    index = hybrid.Index(chunks, bm25.build_index(chunks), vectors)
    qs = ask("read the file code", "File::close", "zzz")
    qv = qs.select("query_id", embed("query").alias("embedding"))
    found = hybrid.search(index, qs, Config(), top_k=3, query_vectors=qv, enable_rewrite=True)
    final = found.final.collect()
    assert max(r["rank"] for r in final) <= 3 and {r["query_id"] for r in final} >= {0, 1}
    assert min((r["rank"], r["chunk_id"]) for r in final if r["query_id"] == 1)[1] == "b"
    assert {r["stage"] for r in found.traces().select("stage").distinct().collect()} == set("bm25 vector rrf reranker final".split())
    unknown = hybrid.search(index, qs, top_k=3, source_label="no such")  # falls back to all
    assert unknown.final.count() == hybrid.search(index, qs, top_k=3).final.count()
    with pytest.raises(ValueError):
        hybrid.collections_of(chunks, "no such", strict=True)
    assert hybrid.search(index, qs, top_k=9, module="gui", query_vectors=qv).final.join(chunks, "chunk_id").select("source_module").distinct().collect()[0][0] == "gui"


def test_cache_split(spark):
    texts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "")], "chunk_id string, text string")
    embed = vector.hashing_embedder(8)
    new = vector.embed_missing(texts, spark.createDataFrame([], "key string, embedding array<double>"), embed, "m").where(vector.IS_VECTOR)
    assert new.count() == 2  # the empty text's zeros aren't kept
    hits, misses = vector.split_cached(texts, new, "m")
    assert {r["chunk_id"] for r in hits.collect()} == {"1", "2", "3"} and misses.count() == 1
    assert vector.split_cached(texts, new, "other")[0].count() == 0
