"""Trees walked by one recursive query."""

import pytest

from litquarry.operators import joins


def test_trees_of_any_depth(spark):
    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(150)]
    nodes = spark.createDataFrame([*chain, (500, None, "other"), (501, 500, "leaf"), (600, 601, "a"), (601, 600, "b"), (700, 999, "orphan")], "id int, up int, name string")
    found = {r["node"]: (r["root"], r["depth"], r["path"]) for r in joins.descend(nodes, node="id", parent="up", name="name").collect()}
    assert set(found) == {*range(150), 500, 501}
    assert found[149] == (0, 149, " / ".join(f"n{k}" for k in range(150))) and found[501] == (500, 1, "other / leaf") and found[0] == (0, 0, "n0")
    with pytest.raises(Exception, match="(?i)recursion"):
        joins.descend(nodes, node="id", parent="up", name="name", deepest=20).collect()


def test_an_empty_tree(spark):
    assert joins.descend(spark.createDataFrame([], "id int, up int, name string"), node="id", parent="up", name="name").collect() == []
