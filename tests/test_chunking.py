import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.schema import ELEMENT, ELEMENT_NAMES


def element(**given):
    base = dict.fromkeys(ELEMENT_NAMES) | dict(params=[], references=[], see_also=[], contains_code=False, type="narrative", source_label="l", source_module="m", file_path="p")
    return tuple((base | given)[n] for n in ELEMENT_NAMES)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), ELEMENT)


def test_known_id(frame):
    assert C.build_chunks(frame(element(remarks="hello", section_title="T"))).first()["chunk_id"] == "6654c580ee6ce9de"


def test_parts_in_order(frame):
    full = element(type="function", symbol_id="A::f", class_name="A", function_name="f", signature="int f(int n)", params=[("n", "int", "count"), ("m", "", "more")], return_desc="sum", remarks="Adds.", example="f(1);")
    text = C.build_chunks(frame(full)).first()["embed_text"]
    assert text == "[SYMBOL] A::f\n[CLASS] A\n[FUNCTION] f\n[SIGNATURE] int f(int n)\n[PARAMS]\n  - n (int): count\n  - m: more\n[RETURN] sum\n[REMARKS] Adds.\n[EXAMPLE] f(1);"
    fields = C.build_chunks(frame(full)).first()["bm25_fields"]
    assert fields["symbol_name"] == "A::f A f" and fields["signature"] == "int f(int n) int n m" and fields["example"] == "f(1);"


def test_what_is_dropped_and_cut(frame):
    rows = C.build_chunks(frame(element(), element(remarks="", signature=""), element(signature="typedef int x;", type="typedef"), element(remarks="y" * 3000)), 100).collect()
    assert [r["type"] for r in rows] == ["typedef", "narrative"] and len(rows[1]["embed_text"]) == 100 and len(rows[1]["bm25_fields"]["remarks"]) == 100


def test_ids_differ_by_remarks_and_collapse(frame):
    a, b = element(remarks="one", section_title="Page 1"), element(remarks="two", section_title="Page 1")
    made = C.build_chunks(frame(a, b, a))
    assert made.select("chunk_id").distinct().count() == 2 and C.collapse_ids(made).count() == 2


def test_store_projection(frame):
    row = C.from_metadata(C.to_metadata(C.build_chunks(frame(element(remarks="r", references=["A<B, C>", "D"]))))).first()
    assert row["references"] == ["A<B", "C>", "D"] and row["symbol_id"] == "" and row["collection"] == "l.m"


def test_result_rows(frame):
    row = C.result_rows(C.build_chunks(frame(element(remarks="z" * 900))).withColumn("score", F.lit(0.123456))).first()
    assert len(row["remarks"]) == 500 and row["score"] == 0.1235
