"""Many equal rows in the search for the nearest vectors."""

import pytest

from panelwright.llm.topk import top_k


@pytest.mark.parametrize("repeated", [0, 50, 100, 150])
def test_twenty_thousand_equal_rows_are_searched(spark, repeated):
    rows = spark.range(20_000).selectExpr(f"CAST({repeated} AS BIGINT) AS vec_id", "array(0.5D, 0.25D) AS embedding")
    other = spark.createDataFrame([(200, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(rows.unionByName(other)).collect())
    want = [(200, i, repeated, 128 * 256) for i in range(1, 6)]  # each of the equal rows counts
    if repeated % 50 == 0:
        want = [(repeated, 1, 200, 128 * 256), *want]
    assert got == want


def test_other_columns_with_the_names_of_outputs_are_not_read(spark):
    rows = [(i, [i / 100, 1.0], i, "x", 2.5) for i in range(120)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string, `query_id.x` double")).collect()
    assert {r.query_id for r in got} == {0, 50, 100} and len(got) == 15
