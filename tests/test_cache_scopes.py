import pytest

from tessera.operators import lookup
from tessera.sources import cache, extract, scan, scopes


def test_an_index_is_kept_and_dropped_with_its_configuration(spark, tmp_path):
    conf = tmp_path / ".ignore"
    conf.write_text("a\n")
    t = {"files": spark.createDataFrame([("a.go", 1)], "path STRING, mtime_ns BIGINT")}
    path, hashes = str(tmp_path / "index"), cache.config_hashes([str(conf), str(tmp_path / "none")])
    assert cache.load_index(spark, path) is None and list(hashes) == [".ignore"]
    cache.save_index(spark, t, path, hashes)
    assert cache.load_index(spark, path, hashes)["files"].count() == 1
    conf.write_text("b\n")
    assert cache.load_index(spark, path, cache.config_hashes([str(conf)])) is None
    spark.createDataFrame([("0", ["files"], {})], "schema_version STRING, tables ARRAY<STRING>, configs MAP<STRING, STRING>").write.mode("overwrite").parquet(path + "/meta")
    with pytest.raises(ValueError):
        cache.load_index(spark, path)
    assert cache.load_index(spark, path, strict=False)["files"].count() == 1


def test_validation_trends_and_roots(spark, tmp_path):
    f = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "path STRING, mtime_ns BIGINT")
    now = spark.createDataFrame([("a", 5), ("b", 6)], "path STRING, mtime_ns BIGINT")
    assert {r["state"]: r["files"] for r in cache.validation(f, now).collect()} == {"ok": 1, "stale": 1, "missing": 1}
    for commit in ("c1", "c2"):
        cache.append_trend(spark.createDataFrame([(3,)], "files INT"), str(tmp_path / "t"), commit)
    assert sorted(r["commit"] for r in spark.read.json(str(tmp_path / "t")).collect()) == ["c1", "c2"]
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / ".owners").write_text("")
    assert cache.workspace_root(str(tmp_path / "x" / "y"), (".owners",)) == str(tmp_path / "x") and cache.workspace_root("/", (".no-such-file",)) is None


def test_a_failing_enricher_is_left_out(spark):
    df, calls = spark.createDataFrame([(1,)], "a INT"), []
    e = cache.Enrichers()
    e.register("late", lambda d: d.selectExpr("*", "b + 1 AS c"), 50)
    e.register("early", lambda d: d.selectExpr("*", "a + 1 AS b"), 0)
    e.register("broken", lambda d: calls.append(1) or d.select("nothing"), 60)
    e.register("other", lambda d: 1 / 0, 5, supports=lambda what: what == "x")
    for _ in range(5):
        out = e.apply(df)
    assert out.columns == ["a", "b", "c"] and len(calls) == 3


def test_type_shapes(spark):
    go = "package a\n\ntype S struct {\n\ta int\n\tB, c string `x`\n\t*Base\n}\n\ntype I interface {\n\tGet(x int) string\n\tPut()\n}\n"
    py = "class A(Protocol):\n    x: int = 1\n    def f(self): self.y = 1\n    class B:\n        z = 2\n"
    df = spark.createDataFrame([("a.go", go), ("b.py", py), ("c.py", "def ("), ("d.rs", "pub struct P {\n  pub a: u8,\n  b: Vec<u8>,\n}\ntrait T {\n  fn f(&self);\n}\n"), ("e.go", None)], "path STRING, content STRING")
    got = {(r["path"], r["name"]): (r["fields"], r["interface_width"], r["nesting_depth"]) for r in scopes.type_shapes(df).collect()}
    assert got == {("a.go", "S"): (3, 0, 0), ("a.go", "I"): (0, 2, 0), ("b.py", "A"): (2, 1, 0), ("b.py", "B"): (1, 0, 1), ("d.rs", "P"): (2, 0, 0), ("d.rs", "T"): (0, 1, 0)}


def test_names_are_resolved_through_scopes(spark):
    text = "import os\nx = 1\ndef f(x, y=x):\n    z = x\n    return os, z, w\nclass C:\n    def g(self):\n        return f(x)\n"
    t = scopes.scope_tables(spark.createDataFrame([("m.py", text), ("bad.py", "(")], "path STRING, content STRING"))
    found = lookup.resolve_in_scopes(t["refs"], t["scopes"], t["defs"])
    lines = {r["def_id"]: (r["kind"], r["line"]) for r in t["defs"].collect()}
    got = {(r["name"], r["line"]): lines.get(r["def_id"]) for r in found.collect()}
    assert got[("x", 3)] == ("variable", 2) and got[("x", 4)] == ("param", 3) and got[("z", 5)] == ("local", 4) and got[("os", 5)] == ("import", 1)
    assert got[("w", 5)] is None and got[("f", 8)] == ("function", 3) and got[("x", 8)] == ("variable", 2)
    assert {r["kind"] for r in t["scopes"].collect()} == {"file", "function", "class"}


def test_large_generated_files_are_read_fast(spark, tmp_path):
    (tmp_path / "big_pb2.py").write_text("# x\n" + "".join(f"def f{i}(a):\n    return g(a)\nclass C{i}: pass\n" for i in range(4000)))
    (tmp_path / "small.py").write_text("def h(a):\n    return g(a)\n")
    got = {r["path"]: (len(r["symbols"]), len(r["refs"])) for r in scan.index_tree(spark, str(tmp_path)).collect()}
    assert got == {"big_pb2.py": (8000, 0), "small.py": (1, 1)}
    assert extract.top_level("go", "func A() {}\nfunc A() {}\n\tfunc B() {}\n")[0][1] == "A" and len(extract.top_level("go", "func A() {}\nfunc A() {}\n")) == 1
