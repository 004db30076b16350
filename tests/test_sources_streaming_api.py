import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.operators.incremental import IncrementalState
from tessera.sources import extract as X
from tessera.sources import logs, scan
from tessera.streaming import events as E

PY = '''import os
from a.b import c as d

class Box:
    """A box."""

    def put(self, x, y=1):
        if x and y:
            for i in x:
                helper(i)
        return self.take(x)

def helper(z):
    return os.path.join(z)
'''
GO = """package main

import (
\t"fmt"
\tx "m/internal/store"
)

type Store struct {
\ta int
}

func (s *Store) Get(k string) int {
\tif k == "}" && s.a > 1 {
\t\treturn Used(k)
\t}
\treturn 0
}

func Used(k string) int { return len(k) }

func Dead() {}

func main() {
\tfmt.Println(Used("a"))
}
"""


def test_python_is_read_by_its_parser():
    lang, error, symbols, refs, imports = X.extract("r:p/a.py", PY)
    assert (lang, error, imports) == ("python", None, ["a.b", "os"])
    assert [(s[0], s[1], s[3], s[4], s[5]) for s in symbols] == [("class_definition", "Box", "", 4, 11), ("method_definition", "put", "Box", 7, 11), ("function_definition", "helper", "", 13, 14)]
    put = symbols[1]
    assert put[2] == "def put(self, x, y=1)" and put[6:] == (4, 4, 2, 1)
    assert [(r[1], r[2]) for r in refs] == [("helper", 10), ("take", 11), ("join", 14)]
    assert X.extract("a.py", "def (")[1].startswith("SyntaxError") and X.extract("a.txt", "x") == (None, None, [], [], [])


def test_other_languages_are_read_by_patterns():
    _, _, symbols, refs, imports = X.extract("r:p/a.go", GO)
    assert imports == ["fmt", "m/internal/store"]
    assert [(s[0], s[1], s[3], s[4], s[5]) for s in symbols] == [("struct_definition", "Store", "", 8, 10), ("method_definition", "Get", "Store", 12, 17), ("function_definition", "Used", "", 19, 19), ("function_definition", "Dead", "", 21, 21), ("function_definition", "main", "", 23, 25)]
    assert ("Used", 14) in {(r[1], r[2]) for r in refs} and ("Get", 12) not in {(r[1], r[2]) for r in refs}
    for path, text, want in [("a.rs", "pub fn f<T>(x: T) -> T { x }\nstruct S;\n", ["f", "S"]), ("a.java", "public class A {\n  public int m(int x) {\n    return n(x);\n  }\n}\n", ["A", "m"]), ("a.js", "export default class K {}\nconst f = async (x) => x;\nfunction* g() {}\n", ["K", "f", "g"]), ("a.ll", "declare i32 @puts(ptr)\ndefine i32 @main() {\n  %1 = call i32 @puts(ptr @s)\n}\n@s = constant i8 0\n", ["main", "s"]), ("a.s", "main:\n  call puts\n.L1: nop\n", ["main", ".L1"]), ("a.ts", "interface I {}\nexport type T = 1\nenum E {}\n", ["I", "T", "E"])]:
        assert [s[1] for s in X.extract(path, text)[2]] == want


@pytest.fixture
def tree(tmp_path):
    for path, content in {"main.go": GO, "p/a.py": PY, "p/a_test.py": "from p import a\n\ndef test_put():\n    helper(1)\n", "vendor/x.go": "package x\n", ".git/y.go": "package y\n", "p/skip.py": "x = 1\n", "p/readme.txt": "x", "p/bad.py": "def ("}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    return tmp_path


def test_a_tree_is_indexed_and_then_only_what_changed(spark, tree, tmp_path_factory):
    store = tmp_path_factory.mktemp("index")
    first = scan.index_tree(spark, str(tree), ignore="skip.py\n")
    first.write.parquet(str(store / "1"))
    before = spark.read.parquet(str(store / "1"))
    assert {r["path"] for r in before.collect()} == {"main.go", "p/a.py", "p/a_test.py", "p/bad.py"}
    t = X.index_tables(before)
    assert [r["path"] for r in t["errors"].collect()] == ["p/bad.py"] and t["files"].count() == 3
    time.sleep(0.02)
    (tree / "p/a.py").write_text(PY + "\nclass New: pass\n")
    os.remove(tree / "p/bad.py")
    now = scan.listing(spark, str(tree), "skip.py\n")
    assert [r["path"] for r in scan.to_read(now, before).collect()] == ["p/a.py"]
    again = scan.index_tree(spark, str(tree), before, "skip.py\n")
    assert {r["path"] for r in again.collect()} == {"main.go", "p/a.py", "p/a_test.py"}
    assert "New" in {r["name"] for r in X.index_tables(again)["symbols"].collect()}


def test_a_single_file_is_a_tree_of_its_folder(spark, tree):
    assert [r["path"] for r in scan.listing(spark, str(tree / "p" / "a.py"), single=True).collect()] == ["a.py"]


def engine(spark, tree):
    files = scan.listing(spark, str(tree))
    found = X.extracted(scan.read_texts(spark, str(tree), files)).cache()
    t = X.index_tables(found)
    t["files"] = t["files"].join(files.select("path", "size_bytes"), "path")
    t["sources"] = scan.read_texts(spark, str(tree), files)
    t["churn"] = spark.createDataFrame([("main.go", 3, 2)], "file STRING, commits INT, authors INT")
    return Engine(spark, t, module="m")


def test_the_engine_end_to_end(spark, tree):
    e = engine(spark, tree)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(e.call("dead")) == ["Dead", "Get", "put"]
    assert e.call("callgraph", name="main", depth=2).count() == 1
    assert names(e.call("impact", names=["Used"])) == ["Get", "main"]
    assert {r["name"]: r["coverage"] for r in e.call("testmap").where("file LIKE '%.py'").collect()} == {"put": "untested", "helper": "tested"}
    assert names(e.call("grep", pattern="struct_definition[name=/Store/]")) == ["Store"]
    assert {r["key"]: r["n"] for r in e.call("stats").where("by = 'language'").collect()} == {"go": 1, "python": 3}
    assert e.call("refs", name="Used").count() == 2 and e.call("symbols", name="box").count() == 1
    assert names(e.call("symbol_at", file="main.go", line=13)) == ["Get"]
    assert {r["name"] for r in e.call("scope", file="main.go", line=22).collect()} >= {"fmt", "store", "Used", "Dead"}
    assert {r["file"] for r in e.call("files", sort="path").select(F.col("path").alias("file")).collect()} == {"main.go", "p/a.py", "p/a_test.py", "p/skip.py"}
    assert e.call("complexity", top=1).first()["name"] in ("put", "Get")
    assert {r["name"]: r["lcom"] for r in e.call("cohesion").select(F.col("package").alias("name"), "lcom").collect()} == {".": 2, "p": 1}
    assert e.call("context", concept="used", tokens=50).count() == 1
    assert {(r["line"], r["edit"]) for r in e.call("refactor", pattern="function_definition[name=/^Used$/]", new_name="Use", callsites=True).collect()} == {(19, "declaration"), (14, "reference"), (24, "reference")}
    for name, arguments in {"map": {}, "errors": {}, "imports": {"reverse": True}, "fanin": {}, "unresolved": {}, "deps": {}, "cycles": {}, "bridge": {}, "coupling": {}, "types": {}, "hotspot": {}, "risk": {}, "smells": {"severity": "warning"}, "structural": {"pattern": "len($X)"}, "query": {"query": "(Return) @r"}, "lint": {"text_rules": ("no function longer than 3 lines", "no import fmt")}, "boundaries": {"config": "module .\n deny internal/*\n"}, "capa": {}, "reachability": {"package": ".", "apis": ["Used"]}, "reachability ": {"package": "p", "category": "code_eval"}, "similarity": {}, "secrets": {}, "licenses": {}, "packages": {}, "services": {"modules": spark.createDataFrame([("r", "m")], "repo STRING, module STRING")}, "bridge ": {"focus": "root", "depth": 2}, "check": {}, "report": {"owners": [("p/", "team")]}, "review": {"changed": ["main.go"]}, "guardrails": {"file": "main.go"}, "chunk": {"tokens": 20}, "diff": {"before": e.symbols().limit(0)}, "drift": {"base": e}}.items():
        e.call(name.strip(), **arguments).collect()
    with pytest.raises(KeyError):
        e.call("nothing")
    with pytest.raises(ValueError):
        e.call("refactor", pattern="*", new_name="not a name")


def test_logs(spark):
    log = "Alice\n\n10\t2\tmain.go\n5\t1\tutil.go\n\nBob\n\n3\t0\tmain.go\n1\t1\tconfig.go\n\nAlice\n\n2\t0\tmain.go\n-\t-\timg.png"
    df = spark.createDataFrame([("r", log), ("e", ""), ("n", None)], "repo STRING, t STRING")
    got = {r["file"]: (r["commits"], r["authors"]) for r in logs.churn_of_log(df, "repo", "t").collect()}
    assert got == {"main.go": (3, 2), "util.go": (1, 1), "config.go": (1, 1), "img.png": (1, 1)}
    assert [logs.since_phrase(s) for s in ("90d", "6m", "1y", "2w", "", "2024-01-01", "3 months ago")] == ["90 days ago", "6 months ago", "1 years ago", "2 weeks ago", "6 months ago", "2024-01-01", "3 months ago"]
    d = "--- a/x.go\n+++ b/x.go\n@@ -1,2 +5,3 @@ f\n+a\n@@ -9 +20,0 @@\n+++ b/y.go\n@@ -1 +7 @@\n"
    hunks = logs.diff_hunks(spark.createDataFrame([("r", d)], "repo STRING, t STRING"), "repo", "t")
    assert {(r["file"], r["start_line"], r["end_line"]) for r in hunks.collect()} == {("x.go", 5, 7), ("x.go", 20, 20), ("y.go", 7, 7)}
    s = spark.createDataFrame([("x.go", "F", "function_definition", 7, 9), ("x.go", "G", "function_definition", 8, 19), ("y.go", "H", "struct_definition", 1, 9)], "file STRING, name STRING, kind STRING, start_line INT, end_line INT")
    assert [r["name"] for r in logs.changed_symbols(hunks, s).collect()] == ["F"]
    b = "a" * 40 + " 1 1 2\nauthor Ann\nauthor-time 17\n\tx\n" + "a" * 40 + " 2 2\n\ty\n"
    blame = logs.blame_lines(spark.createDataFrame([("f", b)], "file STRING, t STRING"), "file", "t")
    assert {(r["line"], r["author"], r["time"]) for r in blame.collect()} == {(1, "Ann", 17), (2, "Ann", 17)}
    g = logs.diagnostics(spark.createDataFrame([("b", "a.go:3:7: bad: x\nsrc/b.ts(4,5): error T\nnoise")], "k STRING, t STRING"), "k", "t")
    assert {(r["file"], r["line"], r["col"], r["message"]) for r in g.collect()} == {("a.go", 3, 7, "bad: x"), ("src/b.ts", 4, 5, "error T")}


def test_generated_detection_exchange_and_sinks(spark, tmp_path):
    f = spark.createDataFrame([("a/x.pb.go", "package x"), ("a/y.go", "// Code generated by z. DO NOT EDIT.\n"), ("gen/q.go", "package q"), ("h.go", "\n" * 50 + "package h"), ("late.go", "x\n" * 60 + "@generated")], "path STRING, content STRING")
    got = {r["path"]: (r["gen_generator"], r["gen_reason"]) for r in scan.detected(f, "# c\ntool: gen/*.go\n@scan-depth 50\n").collect()}
    assert got == {"a/x.pb.go": ("protobuf", "filename"), "a/y.go": ("go-generate", "marker"), "gen/q.go": ("tool", "config"), "h.go": (None, None), "late.go": (None, None)}
    assert scan.parse_generated_config("@scan-depth 900\nx.go")[0] == [("config", "x.go")] and scan.parse_generated_config("@scan-depth 900")[1] == 200
    s = spark.createDataFrame([("a.go", "F")], "file STRING, name STRING")
    for repo in ("one", "two"):
        scan.export_index({"symbols": s}, str(tmp_path / "x"), repo)
    got = {r["file"] for r in scan.import_index(spark, str(tmp_path / "x"), "symbols", "file STRING, name STRING", "file").collect()}
    assert got in ({"one:a.go", "two:a.go"}, {"a.go"}) and got == {"one:a.go", "two:a.go"}
    report = scan.sarif([{"rule": "r", "path": "a.go", "line": 0, "message": "m"}])
    assert report["version"] == "2.1.0" and report["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert '"a\\"b" -> "c";' in scan.dot([('a"b', "c")]) and scan.markdown(s) == "| file | name |\n|---|---|\n| a.go | F |"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("path", "kind", "at", "payload"), r))) for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_latest_by_path_over_restarts(spark, tmp_path):
    src, state = str(tmp_path / "in"), E.LatestByPath(spark, str(tmp_path / "state"))
    put(src, "1.json", [("a", "parsed", "2024-01-01T00:00:01", "v1"), ("b", "error", "2024-01-01T00:00:01", "e"), ("c", "parsed", "2024-01-01T00:00:01", "v")])
    E.start(E.read_events(spark, src), state.apply, str(tmp_path / "cp")).awaitTermination()
    put(src, "2.json", [("a", "error", "2024-01-01T00:00:02", "e2"), ("b", "parsed", "2024-01-01T00:00:03", "v"), ("c", "deleted", "2024-01-01T00:00:04", None), ("a", "parsed", "2024-01-01T00:00:00", "old")])
    E.start(E.read_events(spark, src), state.apply, str(tmp_path / "cp")).awaitTermination()
    got = {r["path"]: (r["kind"], r["payload"]) for r in state.current().collect()}
    assert got == {"a": ("error", "e2"), "b": ("parsed", "v")}
    before = state.pointer.read()
    state.apply(spark.createDataFrame([("z", "parsed", None, "x")], E.EVENTS), state.last_batch())  # given again
    assert state.pointer.read() == before and state.current().count() == 2


def test_only_differences_are_handed_on(spark, tmp_path):
    seen = []
    work = IncrementalState(spark, "path", ["payload"], str(tmp_path / "s"))
    each = E.emit_changes(work, lambda df, n: seen.append((n, sorted(r["path"] for r in df.collect()))))
    rows = lambda *x: spark.createDataFrame([(p, v, t) for p, v, t in x], "path STRING, payload STRING, at INT")
    each(rows(("a", "1", 1), ("b", "1", 1)), 0)
    each(rows(("a", "1", 2), ("b", "2", 2), ("b", "0", 1)), 1)
    each(rows(("a", "1", 3)), 2)
    each(rows(("b", "3", 4)), 3)
    each(rows(("b", "3", 4)), 3)
    assert seen == [(0, ["a", "b"]), (1, ["b"]), (3, ["b"])]


def test_sessions_and_running_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    put(src, "1.json", [("b", "parsed", "2024-01-01T00:00:01", ""), ("a", "parsed", "2024-01-01T00:00:02", ""), ("a", "error", "2024-01-01T00:00:02.5", ""), ("c", "parsed", "2024-01-01T00:00:10", "")])
    put(src, "2.json", [("z", "reused", "2024-01-01T00:05:00", "")])
    q = E.sessions(E.read_events(spark, src, 1)).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["paths"] for r in spark.table("batches").orderBy("start").collect()][:2] == [["a", "b"], ["c"]]
    q = E.running_stats(E.read_events(spark, src, 1)).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["kind"]: r["n"] for r in spark.table("counts").groupBy("kind").agg(F.max("n").alias("n")).collect()} == {"parsed": 3, "error": 1, "reused": 1}
