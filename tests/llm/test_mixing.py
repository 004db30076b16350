import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M


def poisson_mean(parameter, cap):
    s = [0.0] + M.steps(parameter, cap)
    p = [b - a for a, b in zip(s, s[1:])]
    return sum(k * x for k, x in enumerate(p)) + cap * (1 - s[-1])


@pytest.mark.parametrize("rate,cap", [(0.1, 1), (0.97, 1), (0.5, 2), (1.0, 2), (1.9, 2), (3.3, 8), (7.99, 8)])
def test_the_cut_distribution_keeps_the_mean(rate, cap):
    assert poisson_mean(M.capped_parameter(rate, cap), cap) == pytest.approx(rate, abs=1e-6)


def test_limits_of_the_rate():
    assert M.steps(M.capped_parameter(2.0, 2), 2) == [0.0, 0.0]
    assert M.steps(M.capped_parameter(0.0, 3), 3) == [1.0, 1.0, 1.0]


def docs(spark, n=3000):
    rows = [(i, "word " * (5 + i % 7), [" Alpha", "beta ", "GAMMA", None, "delta"][i % 5]) for i in range(n)] + [(n, None, "alpha"), (n + 1, "", "beta"), (n + 2, "x" * 25_000, "other")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").withColumn("tokens", F.lit("clash"))


def test_shares_caps_and_missing_sources(spark):
    t = spark.createDataFrame([("Alpha", 0.3, 4), ("Beta", 0.3, 1), ("Gamma", 0.1, 2), ("Nowhere", 0.0, 2), (None, 0.1, 1), ("Delta", 0.3, 3), ("Delta", 0.3, 3)], "source STRING, target_share DOUBLE, max_repeats INT")
    sizes = M.token_counts(docs(spark)).cache()
    plan = M.plan(sizes, t)
    assert {r["source"] for r in plan.where("NOT reachable").collect()} == {"Beta", "Nowhere"}
    copies = M.replicate(sizes, plan).cache()
    caps = {r["source"]: r["m"] for r in copies.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert caps["Beta"] == 1 and caps["Alpha"] <= 4 and caps["Delta"] <= 3 and caps["Gamma"] <= 2
    got = {r["source"]: r for r in M.shares(copies, plan).collect()}
    wanted = {r["source"]: r["rate"] * r["tokens"] for r in plan.collect()}
    for s in ("Alpha", "Gamma", "Delta", "Beta"):
        assert got[s]["mixed_tokens"] == pytest.approx(wanted[s], rel=0.08)
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    out = M.mix(copies)
    assert out.count() == copies.agg(F.sum("copies")).first()[0] == out.select("doc_id", "copy").distinct().count()
    again = {(r["doc_id"], r["copies"]) for r in M.replicate(sizes.repartition(7), plan).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in copies.collect()}


def test_empty(spark):
    t = spark.createDataFrame([("A", 1.0, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    sizes = M.token_counts(docs(spark, 5).limit(0))
    plan = M.plan(sizes, t)
    assert [r["reachable"] for r in plan.collect()] == [False]
    assert M.mix(M.replicate(sizes, plan)).count() == 0
