import random
from datetime import datetime, timedelta

import pytest
from compare import same

from tessera.plans import registry


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Parts and lines of several suppliers."""
    rnd = random.Random(6)
    d = str(tmp_path_factory.mktemp("orders"))
    parts = [(k, f"{rnd.choice(['red', 'blue', 'old'])} {rnd.choice(['ring', 'bolt', 'main'])}", f"Brand#{rnd.randint(1, 5)}", rnd.choice(["BIG", "SMALL"]), rnd.randint(1, 50)) for k in range(40)]
    lines = [(o, n, rnd.randrange(40), rnd.randrange(3), rnd.choice("RAN"), datetime(1995, 6, 1) + timedelta(days=rnd.randrange(400))) for o in range(60) for n in range(rnd.randint(1, 5))]
    spark.createDataFrame(parts, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ").write.parquet(f"{d}/lineitem.parquet")
    return d


GRAPHS = ["call_edges", "tiered_resolution", "unresolved_calls", "fan_in_out", "dead_code", "walk_forward", "walk_reverse", "impact_distance", "test_mapping", "reach_targets", "cohesion", "import_cycles", "import_cycle_members", "import_depth", "dependency_tops", "package_coupling", "feature_envy", "unstable_dependencies", "boundary_check", "architecture_drift"]


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_queries_against_their_sql_over_every_line(spark, orders, name):
    ok, what = same(spark, name, registry.QUERIES[name], registry.ORACLE[name], orders)
    assert ok, what


def test_no_graph_query_filters_lines_by_date():
    for name in GRAPHS:
        assert name == "architecture_drift" or "l_shipdate" not in registry.ORACLE[name]
