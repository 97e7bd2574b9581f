import pytest

from lectern.cli import main
from lectern.config import Config, FieldWeights, load_config, save_config
from lectern.engine import OPERATIONS, Engine, call

HEADER = "/** A mill. */\nclass Mill {\n  // Cuts deep into stock\n  int cut(int depth);\n  // Stops it\n  void halt();\n};\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "01").mkdir()
    (root / "01" / "mill.h").write_text(HEADER)
    (root / "guide.html").write_text("<h1>Cutting guide</h1><p>How to cut stock with a mill and code.</p><h2>Stopping</h2><p>Call halt to stop.</p>")
    e = Engine(spark, Config(db_path=str(tmp_path_factory.mktemp("db"))))
    e.add_doc_source("sdk", str(root))
    e.root = root
    totals = e.reindex()
    assert totals.errors == {} and totals.files == 2 and totals.chunks >= 4
    return e


def test_lookups(engine):
    assert len(OPERATIONS) == 11 and all(callable(getattr(engine, n)) for n in OPERATIONS)
    assert call(engine, "find_symbol", {"symbol_id": "Mill::cut"})["type"] == "function" and engine.find_symbol("No") is None
    assert [r["symbol_id"] for r in engine.search_docs("Mill::cut", 3)][0] == "Mill::cut"
    assert {r["symbol_id"] for r in engine.get_api_class("Mill")} >= {"Mill", "Mill::cut"}
    assert engine.get_api_function("cut", "Mill")[0]["symbol_id"] == "Mill::cut" and engine.list_modules() == ["01", "root"] and engine.list_modules("none") == []
    with pytest.raises(KeyError):
        call(engine, "drop", {})
    kept = len(engine._kept)
    assert kept and engine.search_docs("Mill::cut", 3)[0]["symbol_id"] == "Mill::cut" and len(engine._kept) == kept
    took = engine.latencies(["cut"])
    assert 0 < took["p50"] == took["p95"] and engine.latencies([]) == {"p50": 0.0, "p95": 0.0}


def test_context_status_and_smart(engine):
    assert "Cutting" in engine.build_context("how to cut stock") or "cut" in engine.build_context("how to cut stock")
    status = engine.index_status()
    assert status["total_chunks"] == status["per_source"]["sdk"] and status["symbols"] == 3 and status["collections"] == 2
    smart = engine.smart_search("cutting", '{"hits": [{"symbol": "Mill<int>::cut"}, {"symbol": "Other"}]}', 3)
    assert smart["matched"] == ["Mill::cut"] and smart["unmatched"] == ["Other"] and not smart["degraded"] and engine.smart_search("x", None)["degraded"]


def test_evaluation(engine, spark):
    want = engine.find_symbol("Mill::cut")["chunk_id"]
    rows = spark.createDataFrame([(1, "Mill::cut", [want]), (2, "nothing like it", ["none"])], "query_id long, query string, relevant array<string>")
    m = engine.evaluate(rows)
    assert m["recall_at_1"] == 0.5 and m["num_zero_recall"] == 1 and m["stages"]["bm25"]["recall_at_5"] == 0.5 and {b["category"] for b in m["bad_cases"]} == {"knowledge_gap"}


def test_incremental_runs_and_removal(engine):
    before = engine.index_status()["total_chunks"]
    assert engine.reindex().files == 0
    (engine.root / "01" / "mill.h").write_text(HEADER.replace("  // Stops it\n  void halt();\n", ""))
    assert engine.reindex().files == 1 and engine.find_symbol("Mill::halt") is None and engine.index_status()["total_chunks"] == before - 1
    (engine.root / "guide.html").unlink()
    totals = engine.reindex()
    assert totals.deleted == 1 and engine.list_modules() == ["01"]
    assert engine.reindex(full=True).files == 1
    engine.add_doc_source("other", str(engine.root))
    with pytest.raises(ValueError):
        engine.add_doc_source("other", str(engine.root))
    engine.remove_doc_source("sdk")
    assert engine.index_status()["total_chunks"] == 0 and engine.search_docs("cut") == []
    with pytest.raises(ValueError):
        engine.remove_doc_source("sdk")


def test_config_file(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("db_path: store\ndoc_sources: {a: docs}\nrrf_k: 60\nweights: {remarks: 2}\n")
    c = load_config(str(f))
    assert c.db_path == str(tmp_path / "store") and c.doc_sources == {"a": str(tmp_path / "docs")} and c.rrf_k == 60 and c.weights == FieldWeights(remarks=2.0) and c.top_k_default == 10
    save_config(c, str(f))
    assert load_config(str(f)) == c and load_config() == Config()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.html").write_text("<h1>Alpha</h1><p>beta gamma</p>")
    at = ["--config", str(tmp_path / "c.yaml")]
    for args in (["source", "add", "s", str(tmp_path / "d")], ["reindex"], ["query", "beta gamma"], ["context", "beta"], ["status"], ["symbol", "x"], ["source", "list"]):
        assert main([*at, *args], spark) == 0
    out = capsys.readouterr().out
    assert '"section_title"' not in out and "beta gamma" in out and '"total_chunks": 1' in out


def test_stream(spark, tmp_path):
    import json

    from lectern.sources.store import Store
    from lectern.streaming.incremental import start

    (tmp_path / "in").mkdir()
    row = {"type": "narrative", "remarks": "hello", "source_label": "s", "source_module": "m", "file_path": "f"}
    (tmp_path / "in" / "1.json").write_text(json.dumps(row))
    store = Store(spark, str(tmp_path / "db"))
    start(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(60)
    (tmp_path / "in" / "2.json").write_text(json.dumps(row | {"remarks": "changed"}))
    start(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(60)
    assert [r["remarks"] for r in store.read("chunks").collect()] == ["changed"]
    e = Engine(spark, Config(db_path=str(tmp_path / "db"), doc_sources={"s": "x"}))
    (hit,) = e.search_docs("changed")
    assert hit["remarks"] == "changed" and store.read("vectors").count() == 1 and {r["term"] for r in store.read("postings").collect()} == {"[remarks]", "changed"}


def _files(root):
    return {str(p) for p in root.rglob("*.parquet")}


def test_one_changed_file_writes_one_collection(spark, tmp_path):
    root, db = tmp_path / "docs", tmp_path / "db"
    for m in range(5):
        (root / f"m{m}").mkdir(parents=True)
        (root / f"m{m}" / "x.h").write_text(f"// About {m}.\nint call{m}(int a);\n")
    (root / "m0" / "empty.h").write_text("// nothing\n")
    e = Engine(spark, Config(db_path=str(db)))
    e.add_doc_source("s", str(root))
    totals = e.reindex()
    assert totals.files == 6 and totals.failed == 0 and set(totals.seconds) == {"crawl", "parse", "chunks", "embed", "postings", "symbols"}
    assert e.reindex().files == 0  # a file without elements isn't parsed again
    names = {"chunks", "vectors", "postings", "symbols"}
    before = {n: _files(db / n) for n in names}
    (root / "m3" / "x.h").write_text("int other(int a);\n")
    assert e.reindex().files == 1 and e.find_symbol("other") and e.find_symbol("call3") is None and e.find_symbol("call4")
    for n in names:
        assert len(_files(db / n) - before[n]) == 1, n  # one file of one part
    for k in range(2):  # old parts go
        (root / "m3" / "x.h").write_text(f"int other{k}(int a);\n")
        e.reindex()
    for n in names:
        assert len(_files(db / n)) <= 5 + 1, n


def test_completed_query_goes_to_the_vectors(engine, spark):
    q = spark.createDataFrame([(1, "cut"), (2, "halt")], "query_id long, query string")
    replies = spark.createDataFrame([(1, '{"completed": "Cutting guide", "sub_queries": [], "variants": []}')], "query_id long, reply string")
    asked = []

    def embed(column):
        asked.append(column)
        return engine.embed(column)

    from lectern.plans import hybrid

    found = hybrid.search(engine.index(), q, engine.config, enable_rewrite=True, replies=replies, embed=embed)
    direct = hybrid.search(engine.index(), spark.createDataFrame([(1, "Cutting guide"), (2, "halt")], q.schema), engine.config, embed=engine.embed)
    assert asked and sorted(map(tuple, found.vector.collect())) == sorted(map(tuple, direct.vector.collect()))


def test_embedding_is_tried_twice(spark):
    from lectern.operators.vector import batched_embedder

    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(1)
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t))] * 2 for t in texts]

    df = spark.createDataFrame([("a",), ("bb",), ("bad",), (None,)], "t string").coalesce(1)
    got = [list(r[0]) for r in df.select(batched_embedder(encode, 2, batch=2, wait=0.0)("t")).collect()]
    assert got == [[1.0, 1.0], [2.0, 2.0], [0.0, 0.0], [0.0, 0.0]] and calls.value == 3
