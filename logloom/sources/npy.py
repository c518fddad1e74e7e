"""Shards of float vectors in NumPy's file format, as a Spark data source that reads row ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class NpySource(DataSource):
    """spark.read.format("npy").load(path): (shard, row, embedding) of `.npy` files in a folder that executors reach."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "shard string, row_in_shard int, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"].removeprefix("file:"), int(options.get("rows", 10_000))

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        out = []
        for f in sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]:
            n = np.load(f, mmap_mode="r").shape[0]
            out += [InputPartition((f, a, min(n, a + self.rows))) for a in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f, a, b = partition.value
        part = np.ascontiguousarray(np.load(f, mmap_mode="r")[a:b], dtype=np.float32)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float32()))
        shard = f.rsplit("/", 1)[-1].removesuffix(".npy")
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), pa.array(np.arange(a, b, dtype=np.int32)), vectors], names=["shard", "row_in_shard", "embedding"])
