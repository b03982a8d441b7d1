"""Running streams: sinks with retries and dead letters, workers that start and stop connectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Batch = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Retry:
    attempts: int = 1
    base: float = 0.1
    most: float = 5.0

    def waits(self) -> list[float]:
        """Doubling from ``base`` up to ``most``, one fewer than attempts."""
        return [min(self.base * 2**k, self.most) for k in range(max(0, self.attempts - 1))]

    def run(self, put: Batch, batch: DataFrame, sleep: Callable[[float], None] = time.sleep) -> None:
        waits = self.waits()
        for k in range(max(1, self.attempts)):
            try:
                return put(batch)
            except Exception:
                if k >= len(waits):
                    raise
                sleep(waits[k])


def dead_letters(put: Batch, bury: Batch, retry: Retry = Retry()) -> Batch:
    """A batch function: what still fails after all attempts goes to ``bury`` as a whole."""

    def run(batch: DataFrame) -> None:
        try:
            retry.run(put, batch)
        except Exception:
            bury(batch)

    return run


def split_errors(out: Batch, bury: Batch, error: str = "error") -> Batch:
    """A batch function: records with an error go to ``bury``, others to ``out``; the batch is made once."""

    def run(batch: DataFrame) -> None:
        batch = batch.persist()
        try:
            out(batch.where(F.col(error).isNull()).drop(error))
            bury(batch.where(F.col(error).isNotNull()))
        finally:
            batch.unpersist()

    return run


def fan_out(sinks: Mapping[str, Batch], by: str = "target") -> Batch:
    """A batch function: each record to the sink that ``by`` names; the batch is made once for all."""

    def run(batch: DataFrame) -> None:
        batch = batch.persist()
        try:
            for name, put in sinks.items():
                put(batch.where(F.col(by) == name).drop(by))
        finally:
            batch.unpersist()

    return run


@dataclass
class Stats:
    """What a connector has put out so far."""

    records: int = 0
    bytes: int = 0
    batches: int = 0
    failures: int = 0
    seconds: float = 0.0


def counted(put: Batch, batch: DataFrame, stats: Stats) -> None:
    """Put a batch and add its counts; the batch is made once for both."""
    size = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("key", "value") if c in batch.columns]
    batch = batch.persist()
    try:
        put(batch)
        found = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(size, F.lit(0)).cast("long")), F.lit(0)).alias("bytes")).first()
        stats.records += found.n
        stats.bytes += found.bytes
    finally:
        batch.unpersist()


@dataclass
class Worker:
    """Named streams from sources to sinks. Each has its own checkpoint, so each resumes where it was."""

    checkpoints: str
    queries: dict[str, StreamingQuery] = field(default_factory=dict)
    numbers: dict[str, Stats] = field(default_factory=dict)

    def add(self, name: str, stream: DataFrame, put: Batch, retry: Retry = Retry(), bury: Batch | None = None, every: str | None = None) -> StreamingQuery:
        """Start a connector; without ``every`` it takes what is there and ends."""
        if name in self.queries and self.queries[name].isActive:
            raise ValueError(f"a connector of this name runs: {name}")
        stats = self.numbers.setdefault(name, Stats())

        def run(batch: DataFrame, _: int) -> None:
            stats.batches += 1
            began = time.monotonic()
            try:
                retry.run(lambda b: counted(put, b, stats), batch)
            except Exception:
                stats.failures += 1
                if bury is None:
                    raise
                bury(batch)
            finally:
                stats.seconds += time.monotonic() - began

        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.checkpoints}/{name}")
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        self.queries[name] = writer.start()
        return self.queries[name]

    def remove(self, name: str) -> None:
        self.queries.pop(name).stop()

    def wait(self) -> None:
        for q in list(self.queries.values()):
            q.awaitTermination()

    def stop(self) -> None:
        for name in list(self.queries):
            self.remove(name)

    def stats(self) -> dict[str, Stats]:
        return dict(self.numbers)
