import pytest
from pyspark.sql import functions as F

from tessera.functions import globs, selector, text
from tessera.operators import chunks, diff, metrics, rules, similarity


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"] if values else spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    paths = {"a/b/c.go": "a/b", "c.go": "."}
    for p, want in paths.items():
        assert one(spark, text.dirname("p"), p=p) == want
    for p, want in {"internal/x/y": "internal/x", "cmd": "cmd", "src/a": "src", ".": "root"}.items():
        assert one(spark, text.component("p"), p=p) == want
    assert one(spark, text.body("t", F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, text.code_lines("t"), t="a\n \t\r\n\nb") == 2
    for s, n in {"f()": 0, "f(a)": 1, "f(a, b func(c, d))": 3, "f": 0, "f( )": 0}.items():
        assert one(spark, text.parameter_count("s"), s=s) == n
    for t, n in {"": 0, "  ": 0, "abcd": 1, "abcde": 2, "été": 2}.items():
        assert one(spark, text.token_estimate("t"), t=t) == n
    assert one(spark, text.signature_summary("t"), t="func  f(a int)  {\n x") == "func f(a int)"
    assert one(spark, text.exported("t"), t="Élan") and not one(spark, text.exported("t"), t="elan")
    assert one(spark, text.shortened("t", 10), t="a  b\nccccccccccccc") == "a b ccc..."
    for p, want in {"a/x_test.go": True, "test_a.py": True, "a.spec.ts": True, "FooTest.java": True, "a/tests/x.rs": True, "latest.go": False}.items():
        assert one(spark, text.is_test_file("p"), p=p) == (want or "test" in p)
    for lang, p, want in [("go", "latest.go", False), ("go", "a/tests/x.go", False), ("python", "a/tests/x.py", True), ("Java", "FooTests.java", True), ("tsx", "a.spec.tsx", True), ("rust", "tests/x.rs", True), ("rust", "test_x.rs", False), (None, "latest.go", True)]:
        assert one(spark, text.is_test_file("p", F.lit(lang)), p=p) == want


SYM = "kind STRING, name STRING, signature STRING, receiver STRING, file STRING, start_line INT, end_line INT"


def test_selectors(spark):
    df = spark.createDataFrame([("function_definition", "Get,x", "f(a)", None, "a.go", 5, 9), ("method_definition", "Put", "", "T", "b.py", 20, 30)], SYM)
    find = lambda s: [r["name"] for r in df.where(selector.parse(s)).collect()]
    assert find("*") == ["Get,x", "Put"] and find("method_definition") == ["Put"]
    assert find("*[name=/^Get,x$/,start>=5,end<=9]") == ["Get,x"] and find("*[receiver=/T/]") == ["Put"] and find("*[line=25]") == ["Put"]
    assert find(r"*[file=/\.py$/,signature=/^$/]") == ["Put"] and find("*[name=/(?P<n>P)ut/]") == ["Put"]
    for bad in ("", "*[", "*[name=Get]", "*[start>=0]", "*[start>5]", "*[line>=3]", "*[start>=9,start<=3]", "*[size=3]", "*[name=/a]"):
        with pytest.raises(ValueError):
            selector.parse(bad)
    assert selector.grep_mode("function_definition[name=/x/]") == "selector" and selector.grep_mode("func $X()") == "structural"


def test_ignore_lists_and_globs(spark):
    rules_ = globs.parse_ignore("# c\n*.log\nbuild/\n!keep.log\n/top.txt\nsrc/**/gen\n")
    ig = lambda p: one(spark, globs.ignored("p", rules_), p=p)
    assert [ig(p) for p in ("a.log", "x/a.log", "keep.log", "build/x", "a/build/x", "top.txt", "a/top.txt", "src/gen/x", "src/a/b/gen", "build")] == [True, True, False, True, True, True, False, True, True, False]
    assert [one(spark, globs.indexable("p"), p=p) for p in ("a/b.go", ".git/x", "a/.b/c", "node_modules/x", "vendors/x")] == [True, False, False, False, True]
    assert [one(spark, globs.package_matches("p", g), p="a/b") for g in ("*", "a/*", "a/**", "a/b", "a", "b/*")] == [True, True, True, True, False, False]
    who = [("*", "all"), ("src/", "dev"), ("*.md", "docs")]
    assert [one(spark, globs.owner("p", who), p=p) for p in ("x", "src/a.go", "src/a.md")] == ["all", "dev", "docs"]
    assert one(spark, globs.owner("p", []), p="x") == "(unowned)"


def test_ranks_and_positions(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40, 50)], "v INT")
    assert sorted(r["rank"] for r in metrics.ranked(df, "v", "rank", 1.0).collect()) == [0, 0.25, 0.5, 0.75, 1]
    assert metrics.ranked(df.limit(1), "v", "rank", 0.5).first()["rank"] == 0.5
    ties = spark.createDataFrame([(1,), (1,), (None,), (5,)], "v INT")
    assert sorted(r["rank"] for r in metrics.ranked(ties, "v", "rank", 1.0).collect()) == pytest.approx([0, 1 / 3, 1 / 3, 1])
    vals = spark.createDataFrame([("g", v) for v in range(25)] + [("h", 7), ("h", None)], "g STRING, v INT")
    assert {r["g"]: r["p90"] for r in metrics.p90_at_floor(vals, ["g"], "v").collect()} == {"g": 21, "h": 7}
    assert metrics.p90_at_floor(vals.limit(0), ["g"], "v").count() == 0


def test_hotspots_and_risk_order(spark):
    f = spark.createDataFrame([(1, "a", 1, 1, 1), (2, "b", 5, 4, 4), (3, "c", 15, 10, 10)], "id INT, file STRING, cyclomatic INT, fan_in INT, fan_out INT")
    churn = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 9, 3)], "file STRING, commits INT, authors INT")
    risk = {r["id"]: r["risk"] for r in metrics.risks(f, churn, spark.createDataFrame([], "id INT")).collect()}
    assert 0 <= risk[1] < risk[2] < risk[3] <= 1
    hot = {r["id"]: r["score"] for r in metrics.hotspots(f, churn).collect()}
    assert hot[3] == 1.0 and hot[1] == pytest.approx(0.01)


def test_coupling_of_two_packages(spark):
    p = spark.createDataFrame([("a",), ("b",), ("lone",)], "package STRING")
    e = spark.createDataFrame([("a", "b"), ("a", "a")], "src STRING, dst STRING")
    got = {r["package"]: (r["ce"], r["ca"], r["instability"]) for r in metrics.coupling(p, e, spark.createDataFrame([], "package STRING, kind STRING")).collect()}
    assert got == {"a": (1, 0, 1.0), "b": (0, 1, 0.0), "lone": (0, 0, 0.0)}


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 3), ("g", 2, 4), ("g", 3, 9), ("g", 4, 1), ("h", 1, 99)], "g STRING, o INT, c INT")
    assert [(r["g"], r["o"]) for r in metrics.packed(df, ["g"], ["o"], "c", 8).collect()] == [("g", 1), ("g", 2)]


def test_thresholds_gate_and_smells(spark):
    f = spark.createDataFrame([("a", "p/q", 31, 250, 25, 31, 6, 5), ("b", "z", 3, 10, 1, 0, 5, None)], "name STRING, package STRING, cyclomatic INT, lines INT, fan_out INT, fan_in INT, parameters INT, max_nesting INT")
    got = {(r["name"], r["metric"]) for r in rules.violations(f, {"cyclomatic": 25, "parameters": 7, "max_nesting": 4}, ["name"]).collect()}
    assert got == {("a", "cyclomatic"), ("a", "max_nesting")}
    assert rules.violations(f, {"cyclomatic": 1}, ["name"], "p/*").count() == 1
    assert {r["metric"]: r["passed"] for r in rules.gate(f, {"cyclomatic": 30, "lines": 300, "fan_in": 0}).collect()} == {"cyclomatic": False, "lines": True}
    assert {r["smell"] for r in rules.function_smells(f, ["name"]).where("name = 'a'").collect()} == {"god_function", "shotgun_surgery", "long_params", "deep_nesting"}
    assert [r["failures"] for r in rules.gate(f.limit(0), {"lines": 1}).collect()] == [0]


def test_boundaries_capabilities_and_suppressions(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c/d"), ("b", "c/d"), ("a", "a")], "src STRING, dst STRING")
    r = rules.parse_boundaries("module a\n deny b # no\n allow c/*\nmodule b\n allow x\n")
    assert {(x["src"], x["dst"], x["rule"]) for x in rules.boundary_violations(e, r).collect()} == {("a", "b", 0), ("a", "b", 1), ("b", "c/d", 2)}
    assert rules.boundary_violations(e, []).count() == 0
    with pytest.raises(ValueError):
        rules.parse_boundaries("deny b")
    calls = lambda *names: spark.createDataFrame([("m.c", n) for n in names], "file STRING, name STRING")
    caps = lambda *names: [x["capability"] for x in rules.capabilities(calls(*names), ["file"]).collect()]
    assert caps("VirtualAllocEx", "WriteProcessMemory") == [] and caps("VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread") == ["Process Injection"] and caps("socket") == ["Network Communication"]
    src = spark.createDataFrame([("f", "x\n// lint:ignore r1\ny\n// lint:ignore *\nz"), ("g", "// lint:ignore-file r2\n")], "path STRING, content STRING")
    found = spark.createDataFrame([("f", 3, "r1"), ("f", 3, "r2"), ("f", 5, "r9"), ("g", 7, "r2"), ("g", 7, "r1")], "path STRING, line INT, rule STRING")
    assert {(x["path"], x["line"], x["rule"]) for x in rules.unsuppressed(found, rules.suppressions(src, "path", "content"), "path").collect()} == {("f", 3, "r2"), ("g", 7, "r1")}
    assert rules.parse_text_rule("no function longer than 50 lines") == ("lines", 50) and rules.parse_text_rule("no import 'fmt'") == ("import", "fmt")
    s = spark.createDataFrame([("a", "x\npassword = 'hunter22'\n"), ("b", "fine")], "path STRING, content STRING")
    assert [(x["path"], x["line"], x["rule"]) for x in rules.pattern_lines(s, "path", "content", rules.SECRETS).collect()] == [("a", 2, "assigned_secret")]


def test_similarity_against_brute_force(spark):
    bodies = {1: "mov eax , [0x401000] ; ret now", 2: "mov eax , [0x402000] ; ret now", 3: "a b c d e f g h", 4: "a b c d e f g x", 5: "q", 6: None, 7: ""}
    df = spark.createDataFrame(list(bodies.items()), "id INT, body STRING")
    assert [(r["first_key"], r["members"]) for r in similarity.exact_groups(df, "id", "body").collect()] == [(1, 2)]
    grams = lambda t: {tuple(t.split(" ")[i : i + 3]) for i in range(len(t.split(" ")) - 2)}
    want = len(grams(bodies[3]) & grams(bodies[4])) / len(grams(bodies[3]) | grams(bodies[4]))
    assert [(r["a"], r["b"], r["score"]) for r in similarity.similar(df, "id", "body", 0.5).collect()] == [(3, 4, pytest.approx(want))]


def test_chunks_against_a_plain_loop(spark):
    texts = {1: "\n".join("x" * n for n in (4, 40, 8, 400, 4, 4, 0, 12)), 2: "", 3: "y" * 999, 4: None}
    df = spark.createDataFrame(list(texts.items()), "k INT, t STRING")
    got = {}
    for r in chunks.line_chunks(df, "k", "t", 12).orderBy("k", "chunk").collect():
        got.setdefault(r["k"], []).append((r["start_line"], r["end_line"], r["tokens"]))
    for k, t in texts.items():
        if t is None:
            assert k not in got
            continue
        want, start, used = [], 1, 0
        for i, line in enumerate(t.split("\n"), 1):
            c = -(-len(line) // 4)
            if used + c > 12 and i - 1 >= start:
                want.append((start, i - 1, used))
                start, used = i, 0
            used += c
        assert got[k] == [*want, (start, i, used)]
    assert chunks.snippet_lines(None, None, 20, 25) == (12, 25) and chunks.snippet_lines(3, 9, 5, 100) == (3, 9)


def test_table_and_set_differences(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "k", "y"), (3, None, None)], "i INT, k STRING, v STRING")
    b = spark.createDataFrame([(1, None, "z"), (3, None, None), (4, "n", "w")], "i INT, k STRING, v STRING")
    assert {(r["i"], r["change"]) for r in diff.table_diff(a, b, ["i", "k"], ["v"]).collect()} == {(1, "modified"), (2, "removed"), (4, "added")}
    assert {(r["i"], r["change"]) for r in diff.set_diff(a, b, ["i"]).collect()} == {(2, "removed"), (4, "added")}
