"""Parser queries: pages and headers made from the driver's tables, and in SQL the elements they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queries import query, spread, table
from .sources import registry
from .sources.headers import parse_header_lines


def join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def flat(elements: DataFrame) -> DataFrame:
    """One row an element, arrays as text."""
    params = F.array_join(F.transform("params", lambda p: F.concat_ws("~", p["name"], p["type"], p["desc"])), "|")
    names = ("type", "symbol_id", "class_name", "function_name", "section_title", "signature", "return_desc", "remarks", "example")
    return elements.select(F.col("file_path").cast("bigint").alias("id"), *names, params.alias("params"), F.array_join("see_also", ",").alias("see_also"), F.array_join("references", ",").alias("refs"), "contains_code")


def parsed(spark, files: DataFrame, kind: str) -> DataFrame:
    """files: id, content."""
    return flat(registry.parse_files(files.select("content", F.lit(kind).alias("file_type"), F.lit("s").alias("source_label"), F.lit("m").alias("source_module"), F.col("id").cast("string").alias("file_path"))))


def expected(base: str, *elements: str) -> str:
    """SQL: one row for each element, given as the values of the columns of ``flat`` after id."""
    names = ("type", "symbol_id", "class_name", "function_name", "section_title", "signature", "return_desc", "remarks", "example", "params", "see_also", "refs", "contains_code")
    rows = []
    for e in elements:
        given = dict(x.split(" := ", 1) for x in e.strip().split("\n") if x.strip())
        given = {k.strip(): v.strip() for k, v in given.items()}
        empty = {"params": "''", "see_also": "''", "contains_code": "false"}
        where = f" WHERE {given['where']}" if "where" in given else ""
        rows.append("SELECT id, " + ", ".join(f"CAST({given.get(n, empty.get(n, 'NULL'))} AS {'BOOLEAN' if n == 'contains_code' else 'VARCHAR'}) AS {n}" for n in names) + " FROM base" + where)
    return f"WITH base AS ({base}) " + " UNION ALL ".join(rows)


PART = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size, 'C' || p_partkey AS owner, 'make' || p_size AS func FROM part"


@query(
    "member_pages",
    expected(
        PART,
        """
        type := 'function'
        symbol_id := owner || '::' || func
        class_name := owner
        function_name := func
        signature := 'Unit ' || owner || '::' || func || ' ( int size , Tool t ) const'
        return_desc := 'the ' || name
        remarks := 'Makes a ' || name || '. Returns the ' || name || '. Not & more. Parameters size how many ( ' || size || ' ) t which none make(' || size || ');'
        example := 'make(' || size || ');'
        params := 'size~~how many (' || size || ')|t~~which'
        see_also := CASE WHEN size % 2 = 0 THEN brand || ',stop' ELSE '' END
        refs := CASE WHEN size % 2 = 0 THEN brand || ',stop,' ELSE '' END || owner || ',Unit,Tool'
        contains_code := true
        """,
        """
        type := 'class'
        symbol_id := owner
        class_name := owner
        signature := owner || ' ( )'
        return_desc := 'Returns: a Thing of size ' || size
        remarks := 'Builds. Returns: a Thing of size ' || size
        refs := owner || ',Returns,Thing'
        """,
    ),
)
def _(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"))
    owner, func, name, size = join("C", F.col("p_partkey")), join("make", F.col("p_size")), F.col("p_name"), F.col("p_size")
    see = F.when(size % 2 == 0, join('<dl class="section see"><dt>See also</dt><dd><a href="a.html">', F.col("p_brand"), '</a>, <a href="b.html">stop</a> <a href="c.html"> </a></dd></dl>')).otherwise("")
    one = join(
        '<div class="memitem"><div class="memproto"><table class="memname"><tr><td class="memname">Unit ', owner, "::", func, ' </td><td>( int <em>size</em>,</td><td>Tool t ) const</td></tr></table></div><div class="memdoc"><p>Makes a ', name, ". Returns the ", name, ". Not &amp; more.</p>",
        '<dl class="params"><dt>Parameters</dt><dd><table class="params"><tr><td class="paramname">size</td><td>how many (<b>', size, "</b>)</td></tr><tr><td>t</td><td>which</td></tr><tr><td></td><td>none</td></tr></table></dd></dl>", "<pre>make(", size, ");</pre></div>", see, "</div>",
    )
    two = join('<div class="memitem extra"><span class="memname">', owner, ' ( )</span><div class="memdoc">Builds.<dl class="section return"><dt>Returns: </dt><dd>a Thing of size ', size, "</dd></dl></div></div>")
    page = join('<html><head><meta name="generator" content="Doxygen 1.9"/><title>My lib: ', owner, " Class Template Reference</title></head><body>", one, two, "<script>var x = '<p>';</script></body></html>")
    return parsed(spark, p.select(F.col("p_partkey").alias("id"), page.alias("content")), "html")


@query(
    "help_pages",
    expected(
        PART,
        """
        type := 'function'
        symbol_id := owner || '::' || func
        class_name := owner
        function_name := func
        signature := func || '(int n)'
        return_desc := 'A Status.'
        remarks := 'About ' || name || '. And more.'
        params := 'n~~count ' || size || '|m~~mode'
        see_also := brand
        refs := brand || ',' || owner || ',A,Status'
        """,
        """
        type := 'enum'
        symbol_id := owner || '::Kind' || size
        class_name := owner
        function_name := 'Kind' || size
        signature := 'enum Kind' || size || ' { A, B }'
        refs := owner || ',Kind' || size || ',A,B'
        """,
        """
        type := 'macro'
        symbol_id := owner || '::MAX_' || size
        class_name := owner
        function_name := 'MAX_' || size
        signature := '#define MAX_' || size || ' 7'
        refs := owner || ',MAX_' || size
        """,
    ),
)
def _(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"))
    owner, size = join("C", F.col("p_partkey")), F.col("p_size")
    box = lambda *inner: join('<table style="width:100%; table-layout: fixed"><tr><td>', *inner, "</td></tr></table>")
    call = box("<a href='x'>before</a><h3>make", size, "(int n)</h3><p>About ", F.col("p_name"), '.</p><p></p><p>And more.</p><table style="border:0"><tr><td>n:</td><td>count ', size, "</td></tr><tr><td>m</td><td> </td><td>mode</td></tr></table><p>Returns A Status.</p><a href='y'>", F.col("p_brand"), "</a><a href='y'>", F.col("p_brand"), "</a>")
    body = box(call, box("<h3>Inherited members</h3><p>none</p>"), box("<h3>enum Kind", size, " { A, B }</h3>"), box("<h3>#define MAX_", size, " 7</h3>"), box("<p>no heading</p>"))
    page = join('<html><head><title>x</title><script src="js/chm-test.js"></script></head><body><div id="content"><h2>Class ', owner, ": Base</h2>", body, "</div></body></html>")
    return parsed(spark, p.select(F.col("p_partkey").alias("id"), page.alias("content")), "html")


@query(
    "older_pages",
    expected(
        PART,
        """
        type := CASE size % 3 WHEN 0 THEN 'class' ELSE 'function' END
        symbol_id := CASE size % 3 WHEN 0 THEN owner WHEN 1 THEN owner || '::' || func ELSE func END
        class_name := CASE size % 3 WHEN 0 THEN owner WHEN 1 THEN owner END
        function_name := CASE size % 3 WHEN 0 THEN NULL ELSE func END
        signature := 'Unit ' || func || '( int a, int b )'
        return_desc := 'A Status of ' || name
        remarks := 'Makes ' || name || ' .'
        example := 'make(1);' || chr(10) || 'make(' || size || ');'
        params := 'a~int~a number ' || size || '|~Tool~the tool|~~alone'
        see_also := brand
        refs := brand || CASE size % 3 WHEN 2 THEN '' ELSE ',' || owner END || ',Unit,A,Status'
        contains_code := true
        """,
    ),
)
def _(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"))
    owner, size, func = join("C", F.col("p_partkey")), F.col("p_size"), join("make", F.col("p_size"))
    title = F.when(size % 3 == 0, join('Data type: "', owner, '"')).when(size % 3 == 1, join("Function: ", owner, "::", func)).otherwise(join('Shader (phong): "', func, '" of it'))
    label = lambda name: f"</TD></TR><TR><TD><B>{name}</B></TD><TD>"
    page = join(
        "<HTML><HEAD><TITLE>", title, "</TITLE></HEAD><BODY><TABLE><TR><TD><B>Name</B></TD><TD>n", label("Function"), "Unit <TABLE><TR><TD>", func, "(</TD></TR><TR><TD>int</TD><TD>a</TD></TR><TR><TD>int b</TD></TR><TR><TD>)</TD></TR></TABLE>",
        label("Description"), "Makes <I>", F.col("p_name"), "</I>.", label("Parameters"), "<TABLE><TR><TD>Type</TD><TD>Name</TD></TR><TR><TD>int</TD><TD>a</TD><TD>a number ", size, "</TD></TR><TR><TD><TT>Tool</TT> x</TD><TD>the tool</TD></TR><TR><TD>alone</TD></TR></TABLE>",
        label("Return value"), "A Status of ", F.col("p_name"), label("Example"), "<PRE>make(1);</PRE>or<PRE>make(", size, ");</PRE>", label("See also"), '<A HREF="b.html">', F.col("p_brand"), "</A> <A NAME='z'>mark</A></TD></TR></TABLE></BODY></HTML>",
    )
    return parsed(spark, p.select(F.col("p_partkey").alias("id"), page.alias("content")), "html")


HEADER = (
    "#ifndef X_{k}\n#define X_{k}\n#define MAX_{k}(a) ((a) + \\\n  {s})\n#include <map>\n",
    "namespace outer {{ namespace inner {{\n\n/**\n * @brief Makes {n}.\n * @param size how many\n */\nclass LIB_EXPORT C{k} : public Base<int> {{\npublic:\n  //! Kinds.\n  enum class Kind : int {{ One, Two = 2 }};\n",
    "  struct Inner {{ int x = 3; void go(); }};\n  C{k}(const C{k}& other) = delete;\n  virtual ~C{k}() {{ stop({s}); }}\n  /* Makes it. */ virtual std::map<int, int> make{s}(const std::map<int, int>& m, unsigned int n, Tool* t = nullptr) const = 0;\n",
    "  bool operator==(const C{k}& o) const;\n  void operator()(int i);\n  int field_{s};\n  typedef std::vector<C{k}> List;\nprivate:\n  using Id = unsigned long;\n  friend class Other;\n}};\n}} }}\n",
    'extern "C" {{\n  // Starts.\n  int start{k}(void);\n}}\ntemplate <typename T, int N = (3 > 2)>\nT clamp(T value, T low);\nclass Later;\nstatic inline int twice(int v) {{ return v * 2; }}\ntypedef void (*Callback)(int);\n#endif\n',
)


def _header(k: Column, s: Column, n: Column) -> Column:
    text = "".join(HEADER).replace("{{", "\0").replace("}}", "\1")
    parts: list = []
    for piece in text.split("{"):
        key, brace, rest = piece.partition("}")
        parts += [{"k": k, "s": s, "n": n}[key], rest] if brace else [piece]
    return join(*(p.replace("\0", "{").replace("\1", "}") if isinstance(p, str) else p for p in parts))


@query(
    "header_scopes",
    expected(
        PART,
        "type := 'macro'\nsymbol_id := 'X_' || id\nfunction_name := 'X_' || id\nrefs := ''",
        "type := 'macro'\nsymbol_id := 'MAX_' || id\nfunction_name := 'MAX_' || id\nsignature := '((a) +    ' || size || ')'\nrefs := ''",
        "type := 'class'\nsymbol_id := owner\nclass_name := owner\nremarks := 'Makes ' || name || '. size how many'\nrefs := owner",
        "type := 'enum'\nsymbol_id := owner || '::Kind'\nclass_name := owner\nfunction_name := 'Kind'\nremarks := 'Kinds.'\nrefs := owner",
        "type := 'class'\nsymbol_id := owner || '::Inner'\nclass_name := 'Inner'\nrefs := 'Inner'",
        "type := 'function'\nsymbol_id := 'Inner::go'\nclass_name := 'Inner'\nfunction_name := 'go'\nsignature := 'void go();'\nrefs := 'Inner'",
        "type := 'function'\nsymbol_id := owner || '::' || owner\nclass_name := owner\nfunction_name := owner\nsignature := owner || '(const ' || owner || '& other) = delete;'\nparams := 'other~const ' || owner || '~'\nrefs := owner",
        "type := 'function'\nsymbol_id := owner || '::~' || owner\nclass_name := owner\nfunction_name := '~' || owner\nsignature := 'virtual ~' || owner || '()'\nrefs := owner",
        "type := 'function'\nsymbol_id := owner || '::' || func\nclass_name := owner\nfunction_name := func\nremarks := 'Makes it.'\nsignature := 'virtual std::map<int, int> ' || func || '(const std::map<int, int>& m, unsigned int n, Tool* t = nullptr) const = 0;'\nparams := 'm~const std::map<int, int>~|n~unsigned int~|~Tool* t = nullptr~'\nrefs := owner",
        "type := 'function'\nsymbol_id := owner || '::operator=='\nclass_name := owner\nfunction_name := 'operator=='\nsignature := 'bool operator==(const ' || owner || '& o) const;'\nparams := 'o~const ' || owner || '~'\nrefs := owner",
        "type := 'function'\nsymbol_id := owner || '::operator()'\nclass_name := owner\nfunction_name := 'operator()'\nsignature := 'void operator()(int i);'\nparams := 'i~int~'\nrefs := owner",
        "type := 'typedef'\nsymbol_id := 'List'\nfunction_name := 'List'\nsignature := 'typedef std::vector<' || owner || '> List;'\nrefs := ''",
        "type := 'typedef'\nsymbol_id := 'Id'\nfunction_name := 'Id'\nsignature := 'using Id = unsigned long;'\nrefs := ''",
        "type := 'function'\nsymbol_id := 'start' || id\nfunction_name := 'start' || id\nsignature := 'int start' || id || '(void);'\nremarks := 'Starts.'\nrefs := ''",
        "type := 'function'\nsymbol_id := 'clamp'\nfunction_name := 'clamp'\nsignature := 'T clamp(T value, T low);'\nparams := 'value~T~|low~T~'\nrefs := ''",
        "type := 'function'\nsymbol_id := 'twice'\nfunction_name := 'twice'\nsignature := 'static inline int twice(int v)'\nparams := 'v~int~'\nrefs := ''",
        "type := 'typedef'\nsymbol_id := 'Callback'\nfunction_name := 'Callback'\nsignature := 'typedef void (*Callback)(int);'\nrefs := ''",
    ),
)
def _(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"))
    return parsed(spark, p.select(F.col("p_partkey").alias("id"), _header(F.col("p_partkey"), F.col("p_size"), F.col("p_name")).alias("content")), "header")


@query(
    "header_lines",
    expected(
        PART,
        "type := 'class'\nsymbol_id := owner\nclass_name := owner\nremarks := 'About ' || name || ' in two lines.'\nrefs := owner",
        "type := 'function'\nsymbol_id := owner || '::' || func\nclass_name := owner\nfunction_name := func\nsignature := 'virtual int ' || func || '(const std::map<int, int>& m, int n) const = 0;'\nparams := 'm~const std::map<int, int>~|n~int~'\nremarks := 'Near.'\nrefs := owner",
        "type := 'enum'\nsymbol_id := owner || '::Kind'\nclass_name := owner\nfunction_name := 'Kind'\nremarks := CASE WHEN size % 12 < 10 THEN 'Far.' END\nrefs := owner",
        "type := 'macro'\nsymbol_id := 'MAX_' || id\nfunction_name := 'MAX_' || id\nsignature := size\nrefs := ''",
        "type := 'typedef'\nsymbol_id := 'id_' || id\nfunction_name := 'id_' || id\nsignature := 'typedef unsigned long id_' || id || ';'\nrefs := ''",
    ),
)
def _(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"))
    k, size = F.col("p_partkey"), F.col("p_size")
    blank = F.repeat(F.lit("\n"), (size % 12).cast("int"))
    text = join("/*\n * About ", F.col("p_name"), "\n * in two lines.\n */\n\nclass LIB_API C", k, " {\n  // Near.\n  virtual int make", size, "(const std::map<int, int>& m, int n) const = 0;\n  // return x(1);\n  return x(1);\n  // Far.\n", blank, "  enum Kind { A };\n#define MAX_", k, " ", size, "\ntypedef unsigned long id_", k, ";\nclass Later;\n")

    def run(batches):
        import pandas as pd

        from .schema import ELEMENT_NAMES

        for b in batches:
            rows = [{**e, "source_label": "s", "source_module": "m", "file_path": str(i)} for i, t in zip(b["id"], b["content"]) for e in parse_header_lines(t)]
            yield pd.DataFrame(rows, columns=ELEMENT_NAMES)

    from .schema import ELEMENT

    return flat(p.select(k.alias("id"), text.alias("content")).mapInPandas(run, ELEMENT))
