"""Lines of files as records, and records as lines of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line without its line ends, keyless."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.lit(None).cast("binary").alias("key"), F.encode(F.regexp_replace("value", "[\r\n]+$", ""), "UTF-8").alias("value"))


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a folder that gets new files."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return lines.select(F.lit(None).cast("binary").alias("key"), F.encode(F.regexp_replace("value", "[\r\n]+$", ""), "UTF-8").alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "append", order: list[str] | None = None, single: bool = False) -> None:
    """Each record's value as a line. ``single`` writes one file in order, through one task."""
    out = df.orderBy(*order) if order else df
    out = out.select(F.decode("value", "UTF-8").alias("value"))
    (out.coalesce(1) if single else out).write.mode(mode).text(path)


def tail_from(path: str, position: int, limit: int = 1 << 20) -> tuple[list[str], int]:
    """Whole lines of a file from a byte position, and the position after them; a line without an end waits."""
    if not os.path.exists(path):
        return [], position
    with open(path, "rb") as f:
        f.seek(position)
        data = f.read(limit)
        end = data.rfind(b"\n") + 1
        while not end and len(data) == limit:
            limit *= 2
            f.seek(position)
            data = f.read(limit)
            end = data.rfind(b"\n") + 1
    return [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in data[:end].splitlines(keepends=True)], position + end


class TailReader(SimpleDataSourceStreamReader):
    """Follows one file by byte position, which is the stream's offset."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, pos = tail_from(self.path, start["pos"])
        return iter([(x,) for x in lines]), {"pos": pos}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        lines, _ = tail_from(self.path, start["pos"], max(1, end["pos"] - start["pos"]))
        return iter([(x,) for x in lines])


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``, then ``readStream.format("tail").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


