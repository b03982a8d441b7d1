"""Web endpoints: polled as a source with a cursor, and called once for each record as a sink."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Poll:
    """One request: where, which query parameter takes the cursor, which response header gives the next."""

    url: str
    cursor_param: str | None = None
    cursor_header: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30

    def fetch(self, cursor: str) -> tuple[list[str], str]:
        """Lines that are not empty, and the next cursor. Any status but 2xx raises."""
        url = self.url
        if self.cursor_param and cursor:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode({self.cursor_param: cursor})
        with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:
            if not 200 <= r.status < 300:
                raise OSError(f"status {r.status}")
            lines = [x for x in r.read().decode("utf-8", "replace").split("\n") if x]
            return lines, (r.headers.get(self.cursor_header) or cursor) if self.cursor_header else cursor


class PollReader(SimpleDataSourceStreamReader):
    """The cursor is the stream's offset, and the endpoint's answer to a cursor is what a batch is.

    A batch that is run again after a failure asks again with the same cursor: it is the same where the
    endpoint answers a cursor alike, as a replayable source must. ``interval`` is the least number of
    seconds between requests; ``header.NAME`` options are sent along.
    """

    def __init__(self, options: dict):
        sent = {k[len("header.") :]: v for k, v in options.items() if k.lower().startswith("header.")}
        lower = {k.lower(): v for k, v in options.items()}
        self.poll = Poll(options["url"], lower.get("cursorparam"), lower.get("cursorheader"), sent, float(lower.get("timeout", 30)))
        self.interval, self.asked = float(lower.get("interval", 0)), float("-inf")

    def initialOffset(self) -> dict:
        return {"cursor": "", "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if time.monotonic() - self.asked < self.interval:
            return iter(()), start
        self.asked = time.monotonic()
        lines, cursor = self.poll.fetch(start["cursor"])
        moved = start["n"] + bool(lines)
        return iter([(x,) for x in lines]), {"cursor": cursor, "n": moved}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self.poll.fetch(start["cursor"])[0]])


class PollSource(DataSource):
    """``readStream.format("poll").options(url=..., cursorParam=..., cursorHeader=..., timeout=..., interval=...)``."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options)


def send(df: DataFrame, url: str, method: str = "POST", headers: dict[str, str] | None = None, timeout: float = 30) -> None:
    """One request for each record, its value as the body; any status but 2xx fails the task, which Spark tries again."""
    sent = {"Content-Type": "application/octet-stream"} | (headers or {})

    def run(rows: Iterator[Row]) -> None:
        for row in rows:
            request = urllib.request.Request(url, data=bytes(row.value or b""), headers=sent, method=method)
            with urllib.request.urlopen(request, timeout=timeout) as r:
                if not 200 <= r.status < 300:
                    raise OSError(f"status {r.status}")

    df.select("value").foreachPartition(run)
