"""Decoders of streams that come in chunks cut anywhere: a table function that holds the half record from row to row.

    SELECT s.* FROM stream_records(TABLE(chunks) PARTITION BY (stream) ORDER BY (n), 'lines') AS s

The table has a stream's key, a number that orders its chunks, and their bytes. `lines`: what newlines part, a carriage return before them removed; `sse`: events,
blocks of `event:` and `data:` fields that empty lines part, the data of several fields joined by newlines. What stands at the end without a newline counts
(an event only with its empty line). Bytes that aren't UTF-8 become the replacement character, but no character that two chunks share is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

RECORD = "stream string, n long, event string, data string"


class StreamRecords:
    def __init__(self) -> None:
        self.half, self.key, self.n, self.kind, self.event, self.data = b"", None, 0, "lines", "", []

    def eval(self, row, kind: str) -> Iterator[tuple]:
        key, _, data = row[0], row[1], row[2]
        self.key, self.kind = str(key), kind
        *whole, self.half = (self.half + bytes(data or b"")).split(b"\n")
        for line in whole:
            yield from self.line(line)

    def line(self, raw: bytes) -> Iterator[tuple]:
        text = raw.removesuffix(b"\r").decode("utf-8", "replace")
        if self.kind == "lines":
            yield self.record("", text)
        elif text:
            field, _, value = text.partition(":")
            value = value.removeprefix(" ")
            if field == "event":
                self.event = value
            elif field == "data":
                self.data.append(value)
        else:
            if self.data:
                yield self.record(self.event or "message", "\n".join(self.data))
            self.event, self.data = "", []

    def record(self, event: str, data: str) -> tuple:
        self.n += 1
        return self.key, self.n, event, data

    def terminate(self) -> Iterator[tuple]:
        if self.half and self.kind == "lines":
            yield self.record("", self.half.removesuffix(b"\r").decode("utf-8", "replace"))


def register(spark: SparkSession) -> None:
    """Makes stream_records known to the session's SQL."""
    spark.udtf.register("stream_records", udtf(StreamRecords, returnType=RECORD))
