"""Chunks by size and rows: groups cut in ranges give what one pass over each group gives."""

import pytest
from pyspark.sql import functions as F

from litquarry.streaming import state


@pytest.mark.parametrize(("bucket_rows", "most_bytes", "most_rows"), [(3, 25, 4), (1000, 25, 100), (7, 10, 2)])
def test_size_chunks_over_ranges(spark, tmp_path, bucket_rows, most_bytes, most_rows):
    rows = [("hot", k * k, k * 7 % 40) for k in range(50)] + [("b", -5, 9), ("b", 3, None), ("b", 4, 30), ("b", 90, 16), ("zero", 1, 0), ("zero", 2, 0), ("zero", 3, 0)]
    wanted, open_ = [], {}
    for kind, at, n in sorted(rows, key=lambda r: (r[0], r[1])):
        chunk, size, held = open_.get(kind, (-1, 0, 0))
        if chunk < 0 or size + (n or 0) > most_bytes or held >= most_rows:
            chunk, size, held = chunk + 1, 0, 0
        open_[kind] = (chunk, size + (n or 0), held + 1)
        wanted.append((kind, at, chunk))

    def write(table, name):
        table.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(table.schema).parquet(f"file://{tmp_path}/{name}")

    table = spark.createDataFrame(rows, "kind string, at long, n long").repartition(3)
    found = state.size_chunks(table, "kind", "at", F.col("n"), most_bytes=most_bytes, most_rows=most_rows, write=write, bucket_rows=bucket_rows)
    assert sorted(map(tuple, found.select("kind", "at", "chunk").collect())) == sorted(wanted)


def test_replay_says_when_it_does_not_end(spark):
    cached = spark.createDataFrame([], "request long, response long")
    answer = lambda new: new.withColumn("response", F.col("request") + 1)
    then = lambda answered: answered.select((F.col("request") + 1).alias("request"))
    with pytest.raises(RuntimeError, match="after 2 waves"):
        state.replay(spark.createDataFrame([(1,)], "request long"), cached, answer, then, most_waves=2, write=lambda table, k: spark.createDataFrame(table.collect(), table.schema))
