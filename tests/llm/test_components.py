import random

from tessera.llm.components import components


def brute(edges):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def run(spark, edges, **kw):
    df = spark.createDataFrame(edges or [], "a BIGINT, b BIGINT")
    return {r["v"]: r["group_id"] for r in components(df, **kw).collect()}


def test_chain_star_and_noise_over_many_cells(spark):
    rnd = random.Random(5)
    ids = list(range(1, 900))
    rnd.shuffle(ids)
    chain = list(zip(ids[:400], ids[1:400]))
    star = [(ids[500], v) for v in ids[501:800]]
    edges = chain + star + [(b, a) for a, b in chain[:50]] + [(7, 7), (None, 3), (ids[880], None), (ids[881], ids[882])]
    assert run(spark, edges, cell_edges=40) == brute(edges)


def test_random_graphs_against_union_find(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)]
        assert run(spark, edges, cell_edges=10) == brute(edges)


def test_empty_and_loops_only(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (None, 2)]) == {}
