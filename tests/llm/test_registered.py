"""Queries and SQL of the operators and the pipeline are registered."""

import __spark_entry__


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {k for k in __spark_entry__.oracle_sql() if k.startswith("op")} == {"op1_decontaminate", "op3_quality_rules", "op4_warc", "op6_url_filter", "op8_mixing", "op11_divergence"}
