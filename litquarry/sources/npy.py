"""NumPy arrays of two dimensions as a data source, one partition for a range of rows, and the files that it reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Rows(InputPartition):
    """``count`` rows of a file from ``first`` on, which are those from ``number`` on of all files."""

    path: str
    first: int
    count: int
    number: int


def _header(f) -> tuple:
    """(shape, dtype, place of the data) of an open file."""
    import numpy as np

    version = np.lib.format.read_magic(f)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if fortran or len(shape) != 2:
        raise ValueError("a row-major array of two dimensions is needed")
    return shape, kind, f.tell()


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("npy needs a path")
        self.path, self.rows = options["path"], int(options.get("rows", 65_536))

    def partitions(self) -> list[Rows]:
        """Only headers are read here. Files of a folder follow one another by name."""
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(place).type == fs.FileType.Directory:
            places = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.path.endswith(".npy"))
        else:
            places = [place]
        found, number = [], 0
        for p in places:
            with store.open_input_file(p) as f:
                total = _header(f)[0][0]
            for first in range(0, total, self.rows):
                count = min(self.rows, total - first)
                found.append(Rows(p, first, count, number))
                number += count
        return found or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        if not partition.count:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            shape, kind, start = _header(f)
            f.seek(start + partition.first * shape[1] * kind.itemsize)
            own = np.frombuffer(f.read(partition.count * shape[1] * kind.itemsize), kind).astype(np.float32)
        rows = pa.array(np.arange(partition.number, partition.number + partition.count), pa.int64())
        vectors = pa.ListArray.from_arrays(np.arange(partition.count + 1, dtype=np.int32) * shape[1], pa.array(own))
        yield pa.RecordBatch.from_arrays([rows, vectors], names=["row", "vector"])


class NpySource(DataSource):
    """``spark.read.format("npy").option("rows", n).load(path)``: (row, vector) of a file or of the .npy files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row bigint, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def write_npy(rows: DataFrame, folder: str, vector: str) -> None:
    """One file a partition, named by its number, of the vectors in their order; empty partitions leave none. Vectors have one size and no nulls."""

    def write(batches) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        # the header tells the number of rows, so a partition's vectors are gathered before they are written
        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            own = np.concatenate(parts)
            draft = f"{place}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": own.shape})
                out.write(own.tobytes())
            store.move(draft, f"{place}/{TaskContext.get().partitionId():06d}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64())], names=["n"])

    rows.select(vector).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
