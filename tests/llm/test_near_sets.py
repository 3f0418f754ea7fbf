"""Whole shingle sets are repeated for hot leaders alone."""

import pytest

from hushline.llm import near_copies


@pytest.mark.parametrize("leaders, most", [(500, 1), (1, None)])
def test_sets_of_leaders_are_not_repeated_without_need(spark, leaders, most):
    pairs = spark.createDataFrame([(1_000 + i, i % leaders) for i in range(1_000)], "sid bigint, leader bigint")
    ids = {k for r in pairs.collect() for k in r}
    grams = spark.createDataFrame([(k, bytes([k % 251])) for k in ids], "sid bigint, grams binary")
    got = near_copies._with_grams(pairs, grams)
    assert sorted((r.sid, r.leader, bytes(r.ga), bytes(r.gb)) for r in got.collect()) == sorted((r.sid, r.leader, bytes([r.sid % 251]), bytes([r.leader % 251])) for r in pairs.collect())
    pieces = near_copies.skew.heavy(pairs, ["leader"])
    assert (pieces == {}) == (most == 1)
