import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tables import write  # noqa: E402

from tessera.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("how", ["empty", "nulls", "clash"])
def test_queries_over_unusual_tables(spark, tmp_path, how):
    d = write(spark, tmp_path / how, how)
    for name, query in Q.QUERIES.items():
        assert query(spark, d).collect() == [] or name.startswith(("p9_mix", "p4_")), name


def test_rows_among_null_rows_and_clashing_columns(spark, tmp_path):
    box = [(60, 100 + 40 * i, 900, 31, None) for i in range(12)]
    words = "anchor ballot candle drought engine farmer garden harbour inquest journey kettle lantern market orchard parish quarry river school tailor uniform".split()
    page = "\n".join(" ".join(words[(i + j) % 20] for j in range(4)) for i in range(0, 48, 4))
    body = " ".join(f"t{i % 17} = f ( {i} )" for i in range(12))
    given = {
        "documents": [(1, page, None, " The Post ", None, None, None, None, None, box), (2, page + "!", "en", "the post", 5, None, 1, 2, None, None), (3, "", None, None, None, None, None, None, None, []), (4, None, None, "x", None, None, None, None, None, None)],
        "eval_items": [(7, " ".join(words), None, None), (8, "", None, None)],
        "mix_targets": [("The Post", 0.5, 1), ("Nobody", 0.1, 2)],
        "prints": [(1, None, None, None, None, None, body, None), (2, None, None, None, None, None, body + " end", None), (3, None, None, None, None, None, body, None), (3, None, None, None, None, None, body, None)],
        "pairs": [(5, 6, None, None), (6, 7, 0.1, "x"), (9, 9, 1.0, "exact")],
        "sources": [("r:a.py", "x = (\n"), ("r:vendor/b.go", "package b\n")],
        "function_metrics": [(i, None, "p", None, None, None, None, None, None, i % 10, None, None, None, None, None, None, None, None, None, None) for i in range(40)],
        "package_risk": [("p", None, 0.5, None, None, None, 2)],
    }
    d = write(spark, tmp_path / "some", "clash", given)
    got = {n: sorted(tuple(r) for r in Q.QUERIES[n](spark, d).collect()) for n in ("p2_found", "p3_found", "p4_found", "p6_found", "p7_found", "p8_found", "p9_found", "p10_found")}
    assert got == {"p2_found": [(1, 2), (1, 3), (2, 3)], "p3_found": [("r:a.py",)], "p4_found": [("p", "p90_cyclomatic")], "p6_found": [("r:vendor/b.go",)], "p7_found": [(5, 5), (6, 5), (7, 5)], "p8_found": [(1, 7), (2, 7)], "p9_found": [("Nobody",)], "p10_found": [(1, 2)]}
