"""A data source of made-up embeddings, to try a corpus' tools on: rows of numbers that depend on the seed and the row alone.

Numbers are drawn in blocks of rows by a counter-based generator, keyed by the seed and the block's number. Partitions are
runs of whole blocks, so a table is the same for any number of them, and a lost partition is drawn again as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparsefold.operators.places import placed
from sparsefold.operators.ranking import sample_n

NAME = "sparsefold_embedding"
#: Rows of a block.
BLOCK = 1024
#: The range of the numbers.
LOW, WIDTH = -0.1, 2.0
#: The lowest number that is inside the range; the one that is nearest to LOW lies below it.
LOWEST = np.float32(LOW) if float(np.float32(LOW)) >= LOW else np.nextafter(np.float32(LOW), np.float32(np.inf))


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


def block(seed: int, number: int, dimensions: int) -> np.ndarray:
    """The rows of one block."""
    draw = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, number, 0]))
    return np.maximum((WIDTH * draw.random((BLOCK, dimensions), dtype=np.float32) + np.float32(LOW)).astype(np.float32), LOWEST)


class EmbeddingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows, self.dimensions = int(options["rows"]), int(options["dimensions"])
        self.seed, self.parts = int(options.get("seed", 0)), int(options.get("partitions", 1))

    def partitions(self) -> list[InputPartition]:
        blocks = -(-self.rows // BLOCK)
        step = max(1, -(-blocks // max(1, self.parts)))
        return [Blocks(at, min(at + step, blocks)) for at in range(0, blocks, step)] or [Blocks(0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        for number in range(partition.first, partition.last):
            start = number * BLOCK
            values = block(self.seed, number, self.dimensions)[: self.rows - start]
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * self.dimensions)
            vectors = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(values))), vectors], ["place", "vector"])


class EmbeddingSource(DataSource):
    """Options: rows, dimensions, seed (0) and partitions (1)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place bigint, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return EmbeddingReader(self.options)


def generated(spark: SparkSession, rows: int, dimensions: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """place (from 0) and vector."""
    spark.dataSource.register(EmbeddingSource)
    return spark.read.format(NAME).options(rows=rows, dimensions=dimensions, seed=seed, partitions=partitions).load()


def test_embedding(axis: DataFrame, rows: int, dimensions: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """id and vector for that many ids drawn from an axis (soma_joinid), in ascending order."""
    ids = placed(sample_n(axis.select("soma_joinid"), rows, seed=seed), ["soma_joinid"])
    return ids.join(generated(axis.sparkSession, rows, dimensions, seed, partitions), "place").select(F.col("soma_joinid").alias("id"), "vector")


test_embedding.__test__ = False
