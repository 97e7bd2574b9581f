import pytest
from pyspark.sql import functions as F

from lectern.sources import crawl, headers, html_pages, pdf, registry
from lectern.sources.queries import read_queries

def box(name: str, inner: str, tag: str = "div") -> str:
    return f'<{tag} class="{name}">{inner}</{tag}>'


_PROTO = box("memproto", "<table><tr>" + box("memname", "double Shape::area", "td") + "<td>( int scale, Unit u ) const</td></tr></table>")
_DOC = "<p>Computes the area. Returns the area in units. See below.</p>" + box("params", "<tr><td>scale</td><td>How large</td></tr>", "table") + box("section see", '<dd><a href="x">Circle</a></dd>', "dl") + "<pre>s.area(2);</pre>"
MEMBER = "<title>Lib: Shape Class Reference</title>" + box("memitem", _PROTO + box("memdoc", _DOC))


def test_member_pages():
    (e,) = html_pages.parse_page(MEMBER.replace("double Shape::area</td>", "double Shape::area ( int scale )</td>"))
    assert e["symbol_id"] == "Shape::area" and e["type"] == "function" and e["class_name"] == "Shape" and e["params"] == [{"name": "scale", "type": "", "desc": "How large"}]
    assert e["return_desc"] == "the area in units" and e["example"] == "s.area(2);" and e["contains_code"] and e["see_also"] == ["Circle"] and e["references"][:2] == ["Circle", "Shape"] and "Unit" in e["references"]


def test_help_pages():
    layout = lambda inner: f'<table style="table-layout:fixed"><tr><td>{inner}</td></tr></table>'
    params = '<table style="border:0"><tr><td>depth:</td><td>How deep</td></tr></table>'
    members = layout("<h3>cut(int depth)</h3><p>Cuts.</p><p>Returns nothing.</p>" + params + '<a href="#">Tool</a>') + layout("<h3>Inherited members</h3>") + layout("<h3>enum Mode</h3>")
    page = '<script src="chm-test.js"></script><div id="content"><h2>class Mill : Base</h2>' + layout(members) + "</div>"
    cut, mode = html_pages.parse_page(page)
    assert cut["symbol_id"] == "Mill::cut" and cut["remarks"] == "Cuts." and cut["return_desc"] == "nothing." and cut["params"][0] == {"name": "depth", "type": "", "desc": "How deep"} and cut["see_also"] == ["Tool"]
    assert mode["type"] == "enum" and mode["symbol_id"] == "Mill::Mode"


def test_older_pages():
    page = '<HTML><TITLE>Function: "Cam::run"</TITLE><TABLE><TR><TD><B>Function</B></TD><TD>int <TABLE><TR><TD>run(</TD></TR><TR><TD>int a</TD></TR><TR><TD>)</TD></TR></TABLE></TD></TR><TR><TD><B>Parameters</B></TD><TD><TABLE><TR><TD>Type</TD><TD>Name</TD></TR><TR><TD>int</TD><TD>a</TD><TD>a number</TD></TR></TABLE></TD></TR><TR><TD><B>Return value</B></TD><TD>A Status</TD></TR><TR><TD><B>Description</B></TD><TD>Runs <I>it</I>.</TD></TR><TR><TD><B>Example</B></TD><TD><PRE>run(1);</PRE></TD></TR><TR><TD><B>See also</B></TD><TD><A HREF="b.html">stop</A></TD></TR></TABLE>'
    (e,) = html_pages.parse_page(page)
    assert e["symbol_id"] == "Cam::run" and e["class_name"] == "Cam" and e["function_name"] == "run" and e["remarks"] == "Runs it ." and e["return_desc"] == "A Status"
    assert e["params"] == [{"name": "a", "type": "int", "desc": "a number"}] and e["example"] == "run(1);" and e["see_also"] == ["stop"] and e["signature"].startswith("int run(")


def test_narrative_pages():
    page = "<body><h1>One</h1><p>First  text.</p>loose<h2>Two</h2><pre>x = 1;</pre><h3></h3><h2>Three</h2></body>"
    one, two = html_pages.parse_page(page)
    assert (one["section_title"], one["remarks"]) == ("One", "First text. loose") and two["section_title"] == "Two"
    (whole,) = html_pages.parse_page("<p>No heads</p>")
    assert whole["remarks"] == "No heads" and html_pages.parse_page("  ") == [] and html_pages.parse_page(None) == []


HEADER = """#define MAX_N 10
#ifndef X
typedef unsigned long id_t;
class Fwd;
/**
 * @brief A shape.
 */
class API_EXPORT Shape : public Base {
public:
  // Area of it
  virtual double area(const std::map<int, int>& m, int scale) const;
  enum Kind { A, B };
};
int free_one(void);
"""


def test_headers_by_line():
    got = {(e["type"], e["symbol_id"]): e for e in headers.parse_header_lines(HEADER)}
    assert set(got) == {("macro", "MAX_N"), ("typedef", "id_t"), ("class", "Shape"), ("function", "Shape::area"), ("enum", "Shape::Kind"), ("function", "Shape::free_one")}
    area = got["function", "Shape::area"]
    assert area["remarks"] == "Area of it" and [p["name"] for p in area["params"]] == ["m", "scale"] and got["class", "Shape"]["remarks"] == "A shape."
    assert got["function", "Shape::free_one"]["params"] == [] and headers.parse_header_lines("") == headers.parse_header(None) == []


def test_headers_by_scope():
    more = HEADER + 'namespace n {\ntemplate <typename T>\nclass Box {\n  struct Inner { int x; void go(); };\n  Box(const Box&) = default;\n  bool operator==(const Box& o) const { return true; }\n  virtual void pure() = 0;\n};\nusing Id = long;\n}\nextern "C" {\nvoid c_call(int n);\n}\nstruct P { int a; };\nenum class Color { Red };\n'
    got = [(e["type"], e["symbol_id"]) for e in headers.parse_header(more)]
    for want in [("macro", "MAX_N"), ("typedef", "id_t"), ("class", "Shape"), ("function", "Shape::area"), ("enum", "Shape::Kind"), ("function", "free_one"), ("class", "Box"), ("class", "Box::Inner"), ("function", "Inner::go"), ("function", "Box::operator=="), ("function", "Box::pure"), ("typedef", "Id"), ("function", "c_call"), ("class", "P"), ("enum", "Color")]:
        assert want in got, (want, got)


def test_paragraphs():
    assert pdf.group_paragraphs(["a" * 10, "b" * 10, "c" * 10], 20) == ["a" * 10 + "\n\n" + "b" * 10, "c" * 10]
    assert pdf.split_long("One two. Three four. Five", 12) == ["One two.", "Three four.", "Five"]
    assert pdf.split_long("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and pdf.split_long("ab cd ef", 5) == ["ab cd", "ef"]
    rows = pdf.page_sections(["First.\n\nSecond.", None, "Third"])
    assert [(r["section_title"], r["remarks"]) for r in rows] == [("Page 1", "First.\n\nSecond."), ("Page 3", "Third")]


def test_registry(spark):
    assert registry.classify_file("a/B.HTML") == "html" and registry.classify_file("x.unknown") == "unknown" and registry.list_types() == ["header", "html", "pdf"] and registry.get_parser("none") is None
    paths = spark.createDataFrame([("a/b.h",), ("c.HTM",), ("d",), ("e.f/g",)], "p string").select(registry.file_type(F.col("p")), crawl.module_of(F.col("p"))).collect()
    assert [tuple(r) for r in paths] == [("header", "a"), ("html", "root"), ("unknown", "root"), ("unknown", "e.f")]
    files = spark.createDataFrame([("<h1>T</h1><p>x</p>", "html", "l", "m", "f.html"), (None, "html", "l", "m", "g.html"), ("y", "odd", "l", "m", "h")], "content string, file_type string, source_label string, source_module string, file_path string")
    assert [r["section_title"] for r in registry.parse_files(files).collect()] == ["T"]


def test_changes(spark, tmp_path):
    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "a.html").write_text("<h1>A</h1><p>a</p>")
    (tmp_path / "b.h").write_text("int f(int a);")
    (tmp_path / "c.txt").write_text("no")
    files = crawl.list_files(spark, "s", str(tmp_path))
    none = spark.createDataFrame([], crawl.STATE)
    first = crawl.changes(files, none)
    assert {(r["rel_path"], r["source_module"], r["needs_index"]) for r in first.collect()} == {("core/a.html", "core", True), ("b.h", "root", True)}
    state = spark.createDataFrame(crawl.next_state(first, none).collect(), crawl.STATE)
    assert not crawl.changes(files, state).where("needs_index").count()
    touched = state.withColumn("mtime", F.col("mtime") - 5)
    assert not crawl.changes(files, touched).where("needs_index").count()
    assert crawl.changes(files, touched.withColumn("sha1", F.lit("x"))).where("needs_index").count() == 2
    gone = state.unionByName(spark.createDataFrame([("s", "old.h", "x", 1, 1)], crawl.STATE))
    assert [r["rel_path"] for r in crawl.deleted(files, gone).collect()] == ["old.h"]
    failed = spark.createDataFrame([("s", "b.h")], "source_label string, rel_path string")
    assert {r["rel_path"] for r in crawl.next_state(first, none, failed).collect()} == {"core/a.html"}
    other = state.withColumn("source_label", F.lit("t"))
    assert crawl.next_state(first, other).count() == 4


def test_annotated_queries(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('# note\n\n{"query": "b", "relevant_chunk_ids": ["1"]}\n{"query": "a"}\n')
    assert [(r["query"], r["relevant"]) for r in read_queries(spark, str(f)).orderBy("query_id").collect()] == [("a", []), ("b", ["1"])]


@pytest.mark.parametrize("name", ["c++ docs", "a.b", "50% [x] {y} *", "ü (1)"])
def test_roots_with_odd_names(spark, tmp_path, name):
    root = tmp_path / name
    (root / "core").mkdir(parents=True)
    (root / "core" / "a b+.html").write_text("<h1>A</h1>")
    (root / "top.h").write_text("int f(int a);")
    for given in (str(root), str(root) + "/", "file://" + str(root)):
        got = {(r["rel_path"], r["source_module"]) for r in crawl.list_files(spark, "s", given).collect()}
        assert got == {("core/a b+.html", "core"), ("top.h", "root")}


def test_report_names_what_failed(spark):
    def broken(text):
        raise ValueError("no such thing")

    registry.register_parser("broken", [".broken"])(broken)
    try:
        files = spark.createDataFrame([("x", "broken", "l", "m", "a"), ("", "header", "l", "m", "b"), ("int f();", "header", "l", "m", "c")], "content string, file_type string, source_label string, source_module string, file_path string")
        report = registry.parse_report(files).cache()
        assert [tuple(r) for r in registry.failures_of(report).collect()] == [("l", "m", "a", "ValueError: no such thing")]
        assert [r["symbol_id"] for r in registry.elements_of(report).collect()] == ["f"] and report.count() == 3
    finally:
        del registry._PARSERS["broken"], registry._TYPES[".broken"]


def test_deep_and_hostile_pages():
    import time

    for piece in ("<div>", "</div>", "<b>x", "<table><tr><td>", "<p></i>"):
        start = time.process_time()
        html_pages.parse_page("<h1>T</h1>" + piece * 40_000 + "end")
        assert time.process_time() - start < 10
    for piece in ("class A {", "void f(", "}", "template <", "[[", "a = {", "x;", "/*", "\"", "#define X \\\n"):
        start = time.process_time()
        headers.parse_header(piece * 10_000)
        headers.parse_header_lines(piece * 10_000)
        assert time.process_time() - start < 10, piece
