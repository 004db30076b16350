import pytest

from tables import write
from tessera.plans import snapshot_queries


@pytest.mark.parametrize("how", ["empty", "nulls", "clash"])
def test_queries_over_unusual_tables(spark, tmp_path, how):
    d = write(spark, tmp_path / how, how)
    for name, query in snapshot_queries.QUERIES.items():
        assert query(spark, d).collect() == [], name
