import pytest

from tessera.operators import incremental as I
from tessera.operators import snapshots as S

SYM = "snapshot_id INT, repo STRING, file STRING, kind STRING, name STRING, signature STRING, receiver STRING, start_line INT, end_line INT, ord INT, loaded_at TIMESTAMP"
IMP = "snapshot_id INT, repo STRING, file STRING, import_path STRING, loaded_at TIMESTAMP"
SNAP = "snapshot_id INT, repo STRING, taken_at TIMESTAMP, complete BOOLEAN"


def at(spark, day):
    return __import__("datetime").datetime(2024, 1, day)


def tables(spark, symbols, imports, snaps):
    s = spark.createDataFrame([(v, r, f, k, n, sig, rec, a, b, 0, at(spark, day)) for v, r, f, k, n, sig, rec, a, b, day in symbols], SYM).selectExpr("*", "1 AS scope", "2 AS vhash", "3 AS turn")
    i = spark.createDataFrame([(v, r, f, p, None) for v, r, f, p in imports], IMP)
    p = spark.createDataFrame([(v, r, None, c) for v, r, c in snaps], SNAP)
    return s, i, p


def changes(spark, *rows):
    return {(r["version_id"], r["file"], r["kind"], r["receiver"], r["name"], r["change"]) for r in S.all_changes(spark, *tables(spark, *rows)).collect()}


def test_changes_of_the_literal_fixture(spark):
    f = "function_definition"
    symbols = [
        (1, "r", "a.go", f, "OldOnly", "func OldOnly()", "", 1, 2, 1), (1, "r", "a.go", f, "Shared", "func Shared(a int)", None, 10, 12, 1),
        (2, "r", "a.go", f, "NewOnly", "func NewOnly()", "", 1, 2, 1), (2, "r", "a.go", f, "Shared", "func Shared(a int, b string)", "", 10, 13, 1),
    ]
    imports = [(1, "r", "a.go", "fmt"), (1, "r", "a.go", " os "), (2, "r", "a.go", "fmt"), (2, "r", "a.go", "strings"), (2, "r", "a.go", "  "), (2, "r", "a.go", None)]
    got = changes(spark, symbols, imports, [(1, "r", True), (2, "r", True)])
    assert got == {(2, "a.go", f, "", "NewOnly", "added"), (2, "a.go", f, "", "OldOnly", "removed"), (2, "a.go", f, "", "Shared", "modified"), (2, "a.go", "import", "", "strings", "added"), (2, "a.go", "import", "", "os", "removed")}


def test_dirty_rows_incomplete_and_empty_deliveries(spark):
    m = "method_definition"
    row = lambda v, n, sig="s", rec="", a=1, day=1, r="r": (v, r, "a.go", m, n, sig, rec, a, 9, day)
    symbols = [
        row(1, "x"), row(1, "x"), row(1, "y", day=1), row(1, "y", sig="later", day=2), row(1, "z", sig=None, rec=None),
        row(2, "ghost"),  # incomplete: passed over
        row(3, "x"), row(3, "y", sig="later", day=5), row(3, "z", sig="", rec=""), row(3, "n", a=None),
        # the delivery 4 is complete and empty
        row(5, "x"), row(1, "only", r="q"), row(9, "late", r="nobody"),
    ]
    got = changes(spark, symbols, [], [(1, "r", True), (2, "r", False), (3, "r", True), (4, "r", True), (5, "r", True), (1, "q", True)])
    assert got == {(3, "a.go", m, "", "n", "added")} | {(4, "a.go", m, "", n, "removed") for n in "xyzn"} | {(5, "a.go", m, "", "x", "added")}


def test_empty_tables(spark):
    assert changes(spark, [], [], []) == set()
    assert changes(spark, [], [], [(1, "r", True), (2, "r", True)]) == set()


def test_a_failed_advance_can_be_repeated(spark, tmp_path):
    index = S.SnapshotIndex(spark, ["signature"], str(tmp_path / "index"), buckets=2)
    rows = lambda names: spark.createDataFrame([("r", "f", "k", None, n, f"sig{n}", 1) for n in names], "scope STRING, file STRING, kind STRING, receiver STRING, name STRING, signature STRING, version_id INT")
    scopes = spark.createDataFrame([("r", 1)], "scope STRING, version_id INT")
    assert index.advance(rows("ab"), scopes).count() == 0
    staged = index.stage(rows("bc"), scopes)  # then the run dies: nothing is swapped
    again = S.SnapshotIndex(spark, ["signature"], str(tmp_path / "index"), buckets=2)
    assert again.pointer.read() != staged
    got = {(r["name"], r["change"]) for r in again.advance(rows("bc"), scopes).collect()}
    assert got == {("a", "removed"), ("c", "added")}
    assert {r["name"] for r in again.rows().collect()} == {"b", "c"}
    # another session doesn't know the table: it is registered again over the same files
    spark.sql(f"DROP TABLE {again.pointer.read()}")
    assert {r["name"] for r in S.SnapshotIndex(spark, ["signature"], str(tmp_path / "index"), buckets=2).rows().collect()} == {"b", "c"}
    # the two versions are bucketed alike, so the join that compares them needs no exchange on either side
    plan = again.probe(again.pointer.read(), scopes)._jdf.queryExecution().executedPlan().toString().split("\n")
    at_join = next(k for k, line in enumerate(plan) if "FullOuter" in line)
    depth = len(plan[at_join]) - len(plan[at_join].lstrip(" :+-"))
    below = []
    for line in plan[at_join + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert sum("SelectedBucketsCount" in x for x in below) == 2 and not any("Exchange" in x for x in below), "\n".join(plan)


def test_old_values_are_fetched_for_changes(spark):
    keys = "scope STRING, file STRING, kind STRING, receiver STRING, name STRING"
    ch = spark.createDataFrame([("r", "f", "k", "", "a")], keys)
    old, new = (spark.createDataFrame([("r", "f", "k", None, "a", v), ("r", "f", "k", "", "b", v)], keys + ", signature STRING") for v in ("one", "two"))
    assert [(r["old_signature"], r["new_signature"]) for r in S.old_and_new(ch, old, new, ["signature"]).collect()] == [("one", "two")]


FILES = "scan_id INT, path STRING, size_bytes BIGINT, mtime_ns BIGINT, listed_at TIMESTAMP"
RUNS = "scan_id INT, started_at TIMESTAMP, status STRING"


def test_runs_handle_exactly_what_is_new(spark):
    f = [(1, "a", 1, 1, 1), (1, "b", 1, 1, 1), (2, "a", 1, 1, 1), (2, "c", 5, 5, 1), (3, "./a", 1, 1, 1), (3, "b", 1, 1, 1), (3, "d", 2, 2, 1), (3, "d", 3, 3, 2), (3, "d", 3, 3, 2), (3, None, 1, 1, 1), (4, "a", None, 1, 1), (4, "b", 1, 1, 1), (4, "d", 3, 3, 1)]
    files = spark.createDataFrame([(s, p, z, m, at(spark, d)) for s, p, z, m, d in f], FILES).withColumn("_hash", __import__("pyspark").sql.functions.lit("clash"))
    runs = spark.createDataFrame([(1, at(spark, 1), "succeeded"), (2, at(spark, 2), "failed"), (3, at(spark, 3), "succeeded"), (4, at(spark, 4), "succeeded")], RUNS)
    got = {(r["scan_id"], r["path"]) for r in I.changed_per_run(spark, files, runs).collect()}
    assert got == {(3, "d"), (4, "a")}
    assert I.changed_per_run(spark, files, runs.limit(0)).count() == 0
    assert I.changed_per_run(spark, files.limit(0), runs).count() == 0


def test_state_is_only_swapped_by_commit(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "path STRING, size_bytes BIGINT")
    w = I.IncrementalState(spark, "path", ["size_bytes"], str(tmp_path / "s"))
    assert w.select(rows(("a", 1), ("b", None))).count() == 2
    w.commit(w.stage(rows(("a", 1), ("b", None))))
    now = rows(("a", 2), ("b", None), ("c", 1))
    w.stage(now)  # a run that fails after staging
    other = I.IncrementalState(spark, "path", ["size_bytes"], str(tmp_path / "s"))
    assert {r["path"] for r in other.select(now).collect()} == {"a", "c"}
    other.commit(other.stage(now))
    assert other.select(now).count() == 0


@pytest.mark.parametrize("version", ["v1", "v2-äö"])
def test_pointer_is_replaced_whole(spark, tmp_path, version):
    p = S.PointerFile(spark, str(tmp_path))
    assert p.read() is None
    p.swap("first")
    p.swap(version)
    assert p.read() == version and [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["CURRENT"]
