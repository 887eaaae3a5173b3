"""Block images as DataFrames: ``block_num, ok, bytes``, empty blocks left out, one task per stretch of the image."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "block_num long, ok boolean, bytes binary"
STRETCH = 64 * 1024 * 1024


def read_at(fd: int, size: int, offset: int, tries: int = 3) -> bytes | None:
    """Exactly ``size`` bytes, or None after ``tries`` failures."""
    for _ in range(tries):
        try:
            raw = os.pread(fd, size, offset)
            if len(raw) == size:
                return raw
        except OSError:
            continue
    return None


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class BlockReader(DataSourceReader):
    """Options: path, blockSize (4096), partitionOffset (0), keepEmpty (false), stretchBytes, firstBlock, lastBlock."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.size = int(options.get("blocksize", 4096))
        self.offset = int(options.get("partitionoffset", 0))
        self.keep = str(options.get("keepempty", "false")).lower() == "true"
        if self.size < SECTOR_MIN or self.size & (self.size - 1):
            raise ValueError("blockSize must be a power of two of at least 512")
        total = max(0, os.stat(self.path).st_size - self.offset) // self.size
        self.first = int(options.get("firstblock", 0))
        self.last = min(total, int(options.get("lastblock", total)))
        self.step = max(1, int(options.get("stretchbytes", STRETCH)) // self.size)

    def partitions(self):
        starts = range(self.first, self.last, self.step)
        return [Stretch(self.path, a, min(a + self.step, self.last)) for a in starts] or [Stretch(self.path, 0, 0)]

    def read(self, partition: Stretch):
        import pyarrow as pa

        fd = os.open(partition.path, os.O_RDONLY)
        try:
            batch = max(1, 4 * 1024 * 1024 // self.size)
            for a in range(partition.first, partition.last, batch):
                b = min(a + batch, partition.last)
                whole = read_at(fd, (b - a) * self.size, self.offset + a * self.size)
                numbers, good, blocks = [], [], []
                for n in range(a, b):
                    raw = whole[(n - a) * self.size : (n - a + 1) * self.size] if whole else read_at(fd, self.size, self.offset + n * self.size)
                    if raw is not None and not self.keep and raw.count(0) == self.size:
                        continue
                    numbers.append(n)
                    good.append(raw is not None)
                    blocks.append(raw if raw is not None else bytes(self.size))
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(good, pa.bool_()), pa.array(blocks, pa.binary())], names=["block_num", "ok", "bytes"])
        finally:
            os.close(fd)


SECTOR_MIN = 512


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def read_blocks(spark: SparkSession, path: str, block_size: int = 4096, partition_offset: int = 0, keep_empty: bool = False, **options) -> DataFrame:
    """The blocks of an image that every executor can open at ``path``. Unreadable blocks come as zeros with ``ok`` false."""
    spark.dataSource.register(BlockSource)
    reader = spark.read.format("blocks").option("path", path).option("blockSize", block_size).option("partitionOffset", partition_offset).option("keepEmpty", str(keep_empty).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
