import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import xref as X


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src BIGINT, dst BIGINT, count BIGINT")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id BIGINT")


def bfs(pairs, root, depth, reverse=False):
    out, todo = {root: 0}, deque([root])
    while todo:
        x = todo.popleft()
        if out[x] == depth:
            continue
        for a, b in pairs:
            if reverse:
                a, b = b, a
            if a == x and b not in out:
                out[b] = out[x] + 1
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_against_breadth_first_search(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(40)]
    e = edges(spark, pairs)
    for reverse in (False, True):
        starts = ids(spark, [0, 1, 77]).withColumn("run", F.col("id"))
        got = {}
        for r in G.distances(e, starts, 3, reverse, ("run",)).collect():
            got.setdefault(r["run"], {})[r["id"]] = r["dist"]
        assert got == {s: bfs(pairs, s, 3, reverse) for s in (0, 1, 77)}
    n = G.distances(e, ids(spark, [0]), 2)
    near = bfs(pairs, 0, 2)
    assert {(r["src"], r["dst"]) for r in G.walk_edges(e, n, 2).collect()} == {p for p in pairs if near.get(p[0], 9) < 2}


def test_components_depths_and_empty_graphs(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(30)] + [(100, v) for v in range(101, 120)] + [(rnd.randrange(200, 240), rnd.randrange(200, 240)) for _ in range(25)]
    nodes = sorted({x for p in pairs for x in p} | {999})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in G.components(edges(spark, pairs), ids(spark, nodes)).collect()} == label
    assert {r["id"]: r["component"] for r in G.components(edges(spark, []), ids(spark, [4])).collect()} == {4: 4}
    assert {r["id"]: r["depth"] for r in G.depths(edges(spark, [(1, 2), (2, 3), (1, 3)]), 10).collect()} == {1: 0, 2: 1, 3: 2}
    assert G.depths(edges(spark, [(1, 2), (2, 1)]), 10).count() == 0
    assert G.distances(edges(spark, []), ids(spark, []), 4).count() == 0


def test_cycles_of_the_fixture_and_longer_ones(spark):
    found = lambda p, k: {tuple(r["cycle"]) for r in G.cycles(edges(spark, p), k).collect()}
    assert found([(1, 2), (2, 1)], 4) == {(1, 2)}
    assert found([(1, 2), (2, 3)], 4) == set()
    assert found([(3, 1), (1, 2), (2, 3), (2, 1), (3, 4), (4, 3), (5, 5)], 4) == {(1, 2), (1, 2, 3), (3, 4)}


def test_members_of_cycles_of_any_length(spark):
    found = lambda p: {(r["id"], r["component"], r["size"]) for r in G.on_cycles(edges(spark, p)).collect()}
    four = [(1, 2), (2, 3), (3, 4), (4, 1)]
    assert found([*four, (4, 5), (5, 6), (6, 7), (7, 6), (8, 1), (9, 9)]) == {(k, 1, 4) for k in (1, 2, 3, 4)} | {(6, 6, 2), (7, 6, 2)}
    assert found([(1, 2), (2, 3), (1, 3)]) == set()


def test_long_chains_are_not_cut(spark):
    pairs = [(i, i + 1) for i in range(45)] + [(0, 30), (50, 44)]
    assert {r["id"]: r["depth"] for r in G.depths(edges(spark, pairs)).collect()} == {**{i: i for i in range(46)}, 50: 0}
    assert max(r["depth"] for r in G.depths(edges(spark, [(0, 1), (1, 2), (2, 1)])).collect()) == 3


def test_shortest_paths_to_targets(spark):
    p = [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1)]
    got = {(r["root"], r["target"]): r["path"] for r in G.reach_paths(edges(spark, p), ids(spark, [1]), ids(spark, [3, 5, 1]), 3).collect()}
    assert got == {(1, 3): [1, 2, 3], (1, 5): [1, 2, 3, 5]}


DEF = "id STRING, file STRING, package STRING, name STRING, kind STRING, receiver STRING"
REF = "file STRING, package STRING, name STRING, caller_id STRING"


def world(spark, defs, refs, imports=()):
    d = spark.createDataFrame([(i, f, f.rpartition("/")[0] or ".", n, k, r) for i, f, n, k, r in defs], DEF)
    r = spark.createDataFrame([(f, f.rpartition("/")[0] or ".", n, c) for f, n, c in refs], REF)
    return r, d, spark.createDataFrame(list(imports), "file STRING, package STRING")


FN, ME = "function_definition", "method_definition"


def test_tiers_decide_in_order(spark):
    defs = [("1", "x/a.go", "Foo", FN, ""), ("2", "y/b.go", "Foo", FN, ""), ("3", "z/d.go", "Bar", FN, ""), ("4", "w/e.go", "Baz", FN, ""), ("5", "z/c.go", "Own", FN, ""), ("6", "x/a.go", "Own", FN, ""), ("7", "x/a.go", "Own", "class_definition", "")]
    refs = [("z/c.go", "Foo", "c"), ("z/c.go", "Bar", "c"), ("z/c.go", "Baz", "c"), ("z/c.go", "Own", "c"), ("z/c.go", "None", "c")]
    tier = lambda imports: {r["name"]: (r["tier"], r["n"]) for r in X.resolve(*world(spark, defs, refs, imports)).collect()}
    assert tier([]) == {"Foo": ("global", 2), "Bar": ("package", 1), "Baz": ("global", 1), "Own": ("file", 1), "None": (None, None)}
    assert tier([("z/c.go", "x")])["Foo"] == ("import", 1)
    u = {r["name"]: (r["reason"], r["candidates"]) for r in X.unresolved(*world(spark, defs, refs)).collect()}
    assert u == {"Foo": ("ambiguous_global", 2), "None": ("no_definition", 0)}


def test_methods_fan_out_and_functions_do_not(spark):
    defs = [("1", "x/a.go", "Run", ME, "A"), ("2", "y/b.go", "Run", ME, "B"), ("3", "x/a.go", "Do", FN, ""), ("4", "y/b.go", "Do", ME, "B")]
    refs = [("z/c.go", "Run", "c"), ("z/c.go", "Run", "c"), ("z/c.go", "Do", "c"), ("z/c.go", "Run", None)]
    got = {(r["callee_id"], r["resolution"], r["count"]) for r in X.call_edges(*world(spark, defs, refs)).collect()}
    assert got == {("1", "poly_global", 2), ("2", "poly_global", 2)}
    got = {(r["callee_id"], r["resolution"]) for r in X.call_edges(*world(spark, defs, refs, [("z/c.go", "y")])).collect()}
    assert got == {("2", "import"), ("4", "import")}
    fan = {r["id"]: (r["fan_in"], r["fan_out"]) for r in X.fan(X.call_edges(*world(spark, defs, refs))).collect()}
    assert fan == {"1": (2, 0), "2": (2, 0), "c": (0, 4)}


def test_innermost_and_first_spans_against_brute_force(spark):
    rnd = random.Random(5)
    spans = [(f, i, s, s + rnd.randrange(200), rnd.randrange(9)) for i, (f, s) in enumerate((rnd.choice("ab"), rnd.randrange(300)) for _ in range(40))] + [("c", 99, 9, 3, 0)]
    refs = [(k, rnd.choice("abc"), rnd.randrange(520)) for k in range(80)]
    s = spark.createDataFrame(spans, "file STRING, id INT, start INT, end INT, ord INT")
    r = spark.createDataFrame(refs, "ref_id INT, file STRING, line INT")
    got = {x["ref_id"]: x["span_id"] for x in X.enclosing(r, s).collect()}
    first = {x["ref_id"]: x["span_id"] for x in X.first_containing(r, s).collect()}
    for k, f, line in refs:
        holds = [(e - b, -b, i, o) for g, i, b, e, o in spans if g == f and b <= line <= e]
        assert got[k] == (min(holds)[2] if holds else None)
        own = [(o, i) for g, i, b, e, o in spans if g == f]
        assert first[k] == (min((o, i) for _, _, i, o in holds)[1] if holds else min(own)[1] if own else None)


def test_import_texts(spark):
    df = spark.createDataFrame([("fmt",), ('import x "a/b"',), ("use a::b::{c}",), ("from os import path",)], "t STRING")
    got = [r[0] for r in df.select(X.import_paths(F.col("t"))).collect()]
    assert got[0] == ["fmt"] and got[1] == ["a/b"] and got[2][:3] == ["use", "a", "b"]
    loc = [r[0] for r in spark.createDataFrame([("m/x/y",), ("m",), ("other/z",)], "p STRING").select(X.local_package("p", "m")).collect()]
    assert loc == ["x/y", ".", None]


def test_modules_are_inferred_by_majority(spark):
    i = spark.createDataFrame([("r", "ex.com/m/a/b"), ("r", "ex.com/m/c"), ("r", "other.com/c"), ("r", "fmt"), ("q", "z/y")], "repo STRING, import STRING")
    d = spark.createDataFrame([("r", "a/b"), ("r", "c"), ("q", "x")], "repo STRING, dir STRING")
    assert {(r["repo"], r["module"], r["votes"]) for r in X.infer_modules(i, d).collect()} == {("r", "ex.com/m", 2)}


def test_references_outside_callables_and_import_words(spark):
    r, d, i = world(spark, [("1", "x/a.go", "Run", FN, "")], [("z/c.go", "Run", None), ("z/c.go", "Run", "c")])
    assert [(x["reason"], x["candidates"]) for x in X.unresolved(r, d, i).collect()] == [("outside_callable", 0)]
    rows = spark.createDataFrame([("a", "use store all"), ("b", "use store all"), ("b", "fmt"), ("c", "m/x"), ("d", " ")], "file STRING, import STRING")
    got = X.import_scope(rows, spark.createDataFrame([("internal/store",), ("x",)], "package STRING"), "m")
    assert {(x["file"], x["package"]) for x in got.collect()} == {("a", "internal/store"), ("b", "fmt"), ("c", "x"), ("c", "m/x")}


def test_samples_order_and_rate_of_edges(spark):
    d = spark.createDataFrame([("c", "b.go", "C", 1), ("x", "a.go", "X", 5), ("y", "a.go", "Y", 9)], "id STRING, file STRING, name STRING, start_line INT")
    e = spark.createDataFrame([("c", "y", 5), ("c", "x", 1), ("x", "y", 1)], "caller_id STRING, callee_id STRING, count INT")
    assert [(r["caller_id"], r["callee_id"]) for r in X.edge_order(e, d).collect()] == [("x", "y"), ("c", "x"), ("c", "y")]
    r = spark.createDataFrame([("c", "b.go", n, 1, "Y") for n in (9, 3, 7, 5)] + [("c", "b.go", 4, 2, "X")], "caller_id STRING, file STRING, line INT, col INT, name STRING")
    got = {(x["caller_id"], x["callee_id"]): [s["line"] for s in x["samples"] or []] for x in X.call_samples(r, e, d).collect()}
    assert got == {("c", "y"): [3, 5, 7], ("c", "x"): [4], ("x", "y"): []}
    rate = X.resolution_rate(e, r.limit(1)).first()
    assert (rate["edges"], rate["unresolved"], rate["rate"]) == (3, 1, 0.75)
    assert X.resolution_rate(e.limit(0), r.limit(0)).first()["rate"] == 0.0


def test_new_cycles(spark):
    got = G.new_cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 2)]), edges(spark, [(1, 2), (2, 1)]), 3).collect()
    assert [tuple(r["cycle"]) for r in got] == [(2, 3)]
