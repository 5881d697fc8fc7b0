"""Hierarchies deeper than any of the tables."""

import pytest

from heddle.operators import graphs


def test_walks_end_at_the_top_or_fail(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 0) for i in range(8)], "node string, parent string, ord int")
    above = {(r.node, r.above): r.depth for r in graphs.closure(chain.select("node", "parent")).collect()}
    assert above == {(f"c{i}", f"c{j}"): j - i for i in range(9) for j in range(i + 1, 9)}
    asks, owns = spark.createDataFrame([("c0", "m")], "cls string, member string"), spark.createDataFrame([("c8", "m")], "cls string, member string")
    bases = chain.toDF("cls", "base", "ord")
    assert [(r.owner, r.depth) for r in graphs.first_owner_up(asks, bases, owns).collect()] == [("c8", 8)]
    with pytest.raises(RuntimeError):
        graphs.closure(chain.select("node", "parent"), 7)
    with pytest.raises(RuntimeError):
        graphs.first_owner_up(asks, bases, owns, 7)
