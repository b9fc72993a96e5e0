"""Places in hash order do not depend on how rows are dealt, and leave no gap."""

import hashlib

from litquarry.operators.sampling import places


def test_places(spark):
    keys = [f"k{i}" for i in range(3000)]
    wanted = {k: i for i, k in enumerate(sorted(keys, key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest()))}
    for parts in (1, 13):
        rows = spark.createDataFrame([(k,) for k in keys], "k string").repartition(parts)
        assert {r["k"]: r["place"] for r in places(rows, "k", seed=7).collect()} == wanted
    assert places(spark.createDataFrame([], "k string"), "k", seed=7).collect() == []
    twice = places(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k", seed=7).collect()
    assert sorted(r["place"] for r in twice) == [0, 1, 2]
