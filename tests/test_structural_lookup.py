import pytest

from tessera.operators import chunks, lookup, metrics, rules
from tessera.sources import structural as S


def test_token_patterns():
    find = lambda p, t, **k: [(m[2], m[3], m[4]) for m in S.find(t, S.Pattern.parse(p), **k)]
    text = "if err != nil {\n  return nil, err\n}\nif x[0] != nil { return x }\n// if a != nil { return b }\n"
    assert find("if $X != nil { return $$$R }", text) == [(1, {"X": "err", "R": "nil, err"}, None)]
    assert find("$F($$$A)", "f(a, (b)) g()")[0][1] == {"F": "f", "A": "a, (b)"}
    assert find("$X == $X", "a == b; c == c") == [(1, {"X": "c"}, None)]
    assert find("$X == $X", "(a+1) == (a + 1)")[0][1] == {"X": "(a+1)"}
    assert find("log($A)", "log(x) log('y')", where={"A": "^'"}, rewrite="print($A)") == [(1, {"A": "'y'"}, "print('y')")]
    assert find("f(", "f('f(')") and not find("f(x", "") and not find("$X { }", "a (")
    with pytest.raises(ValueError):
        S.Pattern.parse("$$$A x")


def test_tree_queries(spark):
    src = spark.createDataFrame([("a.py", "def f(x):\n    return eval(x)\n\nclass C:\n    pass\n"), ("b.py", "def ("), ("c.go", "eval(x)"), ("d.py", None)], "path STRING, content STRING")
    got = {(r["path"], r["capture"], r["node_type"], r["start_line"]) for r in S.tree_query(src, '(Call func: (Name id: "eval") @callee) @violation').collect()}
    assert got == {("a.py", "violation", "Call", 2), ("a.py", "callee", "Name", 2)}
    v = S.query_violations(src, [("no-eval", "error", '(Call func: (Name id: "eval") @callee) @violation'), ("no-class", "warning", '(ClassDef name: "C" @n)')])
    assert {(r["path"], r["line"], r["rule"]) for r in v.collect()} == {("a.py", 2, "no-eval"), ("a.py", 4, "no-class")}
    for bad in ("", "(Call", "(Call) (Call)", "x"):
        with pytest.raises(ValueError):
            S.parse_query(bad)
    g = S.structural_grep(src, "eval($A)", rewrite="safe($A)").collect()
    assert {(r["path"], r["line"], r["captures"]["A"], r["replacement"]) for r in g} == {("a.py", 2, "x", "safe(x)"), ("c.go", 1, "x", "safe(x)")}


SYM = "file STRING, name STRING, kind STRING, start_line INT, end_line INT"


def test_lookups(spark):
    s = spark.createDataFrame([("a", "Outer", "class_definition", 1, 30), ("a", "inner", "method_definition", 5, 9), ("b", "inner", "function_definition", 2, 3)], SYM)
    at = spark.createDataFrame([(1, "a", 6, "inner"), (2, "b", 9, "Outer"), (3, "c", 1, "nothing")], "ref_id INT, file STRING, line INT, name STRING")
    assert {r["ref_id"]: r["name"] for r in lookup.hover(at.drop("name"), s).collect()} == {1: "Outer", 2: None, 3: None}
    resolved = spark.createDataFrame([("a", 6, "b", 2)], "file STRING, line INT, target_file STRING, target_line INT")
    assert {r["ref_id"]: (r["target_file"], r["target_line"]) for r in lookup.definition_of(at, resolved, s).collect()} == {1: ("b", 2), 2: ("a", 1), 3: (None, None)}
    refs = spark.createDataFrame([("c", "inner", 4)], "file STRING, name STRING, line INT")
    assert {(r["file"], r["line"], r["what"]) for r in lookup.references_of("inner", refs, s).collect()} == {("a", 5, "declaration"), ("b", 2, "declaration"), ("c", 4, "reference")}
    assert lookup.workspace_symbols(s, "INN").count() == 2 and lookup.workspace_symbols(s, "").count() == 3
    assert {r["name"]: r["code"] for r in lookup.document_symbols(s, "a").collect()} == {"Outer": 5, "inner": 6}
    blame = spark.createDataFrame([("a", 5, "Ann", 7)], "file STRING, line INT, author STRING, time BIGINT")
    assert {(r["file"], r["name"]): r["author"] for r in lookup.blamed(s, blame).collect()} == {("a", "Outer"): None, ("a", "inner"): "Ann", ("b", "inner"): None}
    d = spark.createDataFrame([("a", 6, "bad"), ("a", 20, "worse")], "file STRING, line INT, message STRING")
    assert {r["name"]: [m["message"] for m in r["messages"]] for r in lookup.diagnosed(s, d).collect()} == {"Outer": ["bad", "worse"], "inner": ["bad"]}


def test_scopes(spark):
    scopes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "scope_id INT, parent_id INT")
    defs = spark.createDataFrame([(10, 1, "x", 1), (11, 2, "x", 2), (12, 2, "x", 1), (13, 4, "y", 1)], "def_id INT, scope_id INT, name STRING, ord INT")
    refs = spark.createDataFrame([(1, 3, "x"), (2, 4, "x"), (3, 3, "y"), (4, 1, "x")], "ref_id INT, scope_id INT, name STRING")
    assert {r["ref_id"]: r["def_id"] for r in lookup.resolve_in_scopes(refs, scopes, defs).collect()} == {1: 12, 2: 10, 3: None, 4: 10}
    v = lambda *r: spark.createDataFrame(list(r), "name STRING, kind STRING, decl_line INT")
    got = {r["name"]: (r["kind"], r["decl_line"]) for r in lookup.visible_at(v(("fmt", "import", 1)), v(("x", "func", 3), ("fmt", "var", 2)), v(("x", "param", 9)), v(("x", "local", 11), ("y", "local", 40)), 20).collect()}
    assert got == {"fmt": ("var", 2), "x": ("local", 11)}


def test_import_targets(spark):
    files = spark.createDataFrame([(p,) for p in ("store/a.go", "store/b.go", "main.go", "p/q.py", "p/__init__.py", "p/sub/r.py", "w/x.ts", "w/y/index.js")], "path STRING")
    imps = spark.createDataFrame([("main.go", "m/store"), ("main.go", "fmt"), ("p/sub/r.py", "p.q"), ("p/sub/r.py", "..q"), ("p/q.py", "p"), ("w/x.ts", "./y"), ("w/y/index.js", "../x"), ("w/x.ts", "react")], "file STRING, import STRING")
    got = {(r["file"], r["import"], r["target"]) for r in lookup.import_targets(imps, files, "m").collect()}
    assert got == {("main.go", "m/store", "store/a.go"), ("main.go", "m/store", "store/b.go"), ("p/sub/r.py", "p.q", "p/q.py"), ("p/sub/r.py", "..q", "p/q.py"), ("p/q.py", "p", "p/__init__.py"), ("w/x.ts", "./y", "w/y/index.js"), ("w/y/index.js", "../x", "w/x.ts")}


def test_package_and_type_rules(spark):
    p = spark.createDataFrame([("a", 16, 51, 4, 0.955, None), ("b", 1, 9, 1, 0.2, 7)], "package STRING, ce INT, symbols INT, lcom INT, instability DOUBLE, import_depth INT")
    assert [r["package"] for r in rules.package_smells(p).collect()] == ["a"]
    assert {(r["package"], r["rule"], r["value"]) for r in rules.package_rules(p, {"lcom": 3, "instability": 90, "import_depth": 6}).collect()} == {("a", "package/lcom", 4), ("a", "package/instability", 95), ("b", "package/import_depth", 7)}
    t = spark.createDataFrame([("f", "G", 21, 16, 0), ("f", "I", 0, 0, 9)], "file STRING, name STRING, method_set_size INT, fields INT, interface_width INT")
    assert {(r["name"], r["smell"]) for r in rules.type_smells(t).collect()} == {("G", "god_type"), ("I", "wide_interface")}
    f = spark.createDataFrame([("cyc", "a/b.go", "F"), ("cyc", "c.go", "G"), ("cog", "a/b.go", None)], "rule STRING, file STRING, name STRING")
    left = lambda *r: {(x["rule"], x["file"]) for x in rules.ignored_by(f, list(r)).collect()}
    assert left(("cyc", "a", "")) == {("cyc", "c.go"), ("cog", "a/b.go")} and left(("*", "b.go", "*")) == {("cyc", "c.go")} and left(("", "", "G")) == {("cyc", "a/b.go"), ("cog", "a/b.go")}


def test_components_and_reports(spark):
    files = spark.createDataFrame([("a/x.go", "a", "A"), ("a/b/y.go", "a/b", "A"), ("c/z.go", "c", "C")], "path STRING, package STRING, component STRING")
    imps = spark.createDataFrame([("a/x.go", "c", True), ("a/x.go", "c", True), ("a/b/y.go", "fmt", False)], "file STRING, import STRING, internal BOOLEAN")
    assert {r["component"]: tuple(r)[1:] for r in metrics.component_metrics(files, imps).collect()} == {"A": (2, 2, 1, 1), "C": (1, 1, 0, 0)}
    ext = spark.createDataFrame([("A", i) for i in ["x"] * 3 + ["y"] * 2 + ["b", "a"]], "component STRING, import STRING")
    assert [tuple(r) for r in metrics.external_tops(ext).collect()] == [("A", 7, ["x", "y", "a"])]
    e = spark.createDataFrame([("a", "b", True), ("a", "fmt", False), ("a", "b", True)], "src STRING, dst STRING, internal BOOLEAN")
    assert tuple(metrics.dependency_report(e).first()) == (3, 2, 1, 1)
    assert tuple(metrics.dependency_report(e.limit(0)).first()) == (0, 0, 0, 0)


def test_symbol_chunks(spark):
    body = "package a\n\nfunc F() {\n" + "  x := 1 // some words\n" * 6 + "}\n"
    texts = spark.createDataFrame([("a.go", body), ("b.txt", "é" * 100), ("c.go", None), ("d.go", "\n\nfunc G() {}\n")], "path STRING, content STRING")
    sym = spark.createDataFrame([("a.go", "function_definition", "F", 3, 10), ("d.go", "function_definition", "G", 3, 3)], "file STRING, kind STRING, name STRING, start_line INT, end_line INT")
    got = {(r["path"], r["kind"]): (r["start_line"], r["end_line"], r["tokens"], r["body"]) for r in chunks.symbol_chunks(texts, sym, 20).collect()}
    assert got["a.go", "file_header"][:3] == (1, 2, 3)
    s, e, n, text = got["a.go", "function_definition"]
    assert (s, e) == (3, 6) and n <= 20 and text.startswith("func F() {")
    assert got["b.txt", "file"][3] == "é" * 80 and got["d.go", "function_definition"][3] == "func G() {}"
    assert ("d.go", "file_header") not in got and not any(p == "c.go" for p, _ in got)


def test_related_scores(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (2, 4, 1)], "src INT, dst INT, count INT")
    got = {r["id"]: (r["dist"], r["score"]) for r in chunks.related(e, spark.createDataFrame([(1,)], "id INT"), 2).collect()}
    assert got == {2: (1, 6), 3: (1, 2), 4: (2, 1)}
