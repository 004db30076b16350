import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import percentiles as P


def test_codes_keep_the_order_and_decode():
    v = np.array([-1e9, -2.5, -0.0, 0.0, 1e-7, 0.5, 3, 1e12])
    c = P.encode(v).astype(np.int64)
    assert (np.diff(c) >= 0).all() and c[2] == c[3]
    assert [P.decode(x) for x in c] == pytest.approx([float(np.float32(x)) for x in v])


@pytest.mark.parametrize("draw", ["uniform", "lognormal", "few"])
def test_rank_error_of_folded_sketches(draw):
    rng = np.random.default_rng(3)
    v = {"uniform": rng.random(150_000), "lognormal": rng.lognormal(1, 2, 150_000), "few": np.concatenate([np.full(60_000, 7.0), rng.random(60_000)])}[draw]
    parts = [P.DyadicSketch(P.encode(x)) for x in np.array_split(v, 5)]
    total = P.DyadicSketch()
    for p in parts:
        total.merge(P.DyadicSketch.from_bytes(p.to_bytes()))
    assert total.folded and total.n == len(v)
    v32 = v.astype(np.float32)
    for q in (0.1, 0.5, 0.9, 0.99):
        x = total.quantile(q)
        below, upto = (v32 < np.float32(x)).mean(), (v32 <= np.float32(x)).mean()
        assert below - 0.015 <= q <= upto + 0.015
    gone = P.DyadicSketch(P.encode(v[: len(v) // 2]), np.full(len(v) // 2, -1))
    total.merge(gone)
    rest = v32[len(v) // 2 :]
    x = total.quantile(0.5)
    assert abs((rest < x).mean() - 0.5) < 0.04 or ((rest < x).mean() <= 0.5 <= (rest <= x).mean())


def test_unfolded_is_exact_and_deletes():
    s = P.DyadicSketch(P.encode(np.arange(101)))
    assert [s.quantile(q) for q in (0, 0.5, 0.9, 1)] == [0, 50, 90, 100]
    s.merge(P.DyadicSketch(P.encode(np.arange(51, 101)), -np.ones(50, np.int64)))
    assert s.n == 51 and s.quantile(1) == 50
    assert P.DyadicSketch().quantile(0.5) is None


def test_spark_path_with_nulls_hot_group_and_empty(spark):
    rows = [("hot", float(i % 977), 1) for i in range(5000)] + [(None, 1.0, 1), ("one", 4.0, 1), ("one", 4.0, 1), ("one", 9.0, -1), ("one", 9.0, 1)]
    df = spark.createDataFrame(rows, "k STRING, value DOUBLE, weight BIGINT").repartition(6)
    got = {r["k"]: (r["n"], r["p50"]) for r in P.quantiles(P.merge(P.build(df, ["k"]), ["k"]), ["k"], [0.5]).collect()}
    want = sorted(float(i % 977) for i in range(5000))[2499]
    assert got == {"hot": (5000, want), None: (1, 1.0), "one": (2, 4.0)}
    assert P.quantiles(P.merge(P.build(df.limit(0), ["k"]), ["k"]), ["k"], [0.5]).count() == 0


def test_measured_leaves_out_what_is_not_measured(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'p', 3, 0.5D, timestamp'2024-01-01 01:00:00', timestamp'2024-01-01 02:00:00'),
      (1, 'p', 3, 0.5D, timestamp'2024-01-01 01:00:00', timestamp'2024-01-01 03:00:00'), (2, 'p', -1, NULL, timestamp'2024-01-01 01:00:00', NULL)
      AS t(function_id, package, cyclomatic, risk, measured_at, loaded_at)""")
    assert sorted((r["metric"], r["value"]) for r in P.measured(df).select("metric", F.col("value")).collect()) == [("p90_cyclomatic", 3.0), ("p90_risk", 0.5)]
