"""A snapshot store as a Python data source: `spark.read.format("snapshots")`.

A snapshot is a revision's files (path, text). It lies in batches, sorted by path, one file each; a manifest line names a batch's
revision, first and last path and number of rows. A read makes a partition of each batch that the pushed filters leave: equality or IN on revision,
equality, prefix or comparison on path. So asking for one revision, or for a folder of it, opens the matching batches only.
The folder may be in any store that pyarrow's file systems know; driver and executors share it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .scratch import scratch_dir

SCHEMA = "revision string, path string, text string"
BATCH = 1000


def opened(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")


class Batch(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class Written(WriterCommitMessage):
    def __init__(self, lines: list[dict]):
        self.lines = lines


def can_hold(line: dict, f: Filter) -> bool:
    """Whether a batch may have rows that pass the filter."""
    (column, *_), low, high = f.attribute, line["first"], line["last"]
    if column == "revision":
        return line["revision"] == f.value if isinstance(f, EqualTo) else line["revision"] in f.value
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value)
    if isinstance(f, StringStartsWith):
        return low[: len(f.value)] <= f.value <= high[: len(f.value)] or low <= f.value <= high
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high >= f.value
    return low <= f.value


class Reader(DataSourceReader):
    def __init__(self, where: str):
        self.where, self.pushed = where, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {"revision": (EqualTo, In), "path": (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)}
        for f in filters:
            if isinstance(f, known.get((getattr(f, "attribute", None) or [None])[0], ())) and getattr(f, "value", None) is not None:
                self.pushed.append(f)
            yield f  # batches are chosen by it, rows are still filtered

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.where)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.base_name):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    lines = [json.loads(x) for x in f.read().decode().splitlines()]
                out += [Batch(x["name"]) for x in lines if all(can_hold(x, f) for f in self.pushed)]
        return out or [Batch("")]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition.name:
            fs, root = opened(self.where)
            yield from pq.read_table(f"{root}/{partition.name}", filesystem=fs, columns=["revision", "path", "text"]).to_batches()


class Writer(DataSourceArrowWriter):
    """Rows should come sorted by revision and path, which written() sees to; each task cuts them into batches of one revision."""

    def __init__(self, where: str, rows: int):
        self.where, self.rows = where, rows

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.where)
        fs.create_dir(root, recursive=True)
        lines, held = [], []

        def put(rows: list[dict]) -> None:
            name = f"batch-{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("revision", "path", "text")])), f"{root}/{name}", filesystem=fs)
            paths = [r["path"] for r in rows]
            lines.append({"name": name, "revision": rows[0]["revision"], "first": min(paths), "last": max(paths), "rows": len(rows)})

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= self.rows or held[0]["revision"] != row["revision"]):
                    put(held)
                    held = []
                held.append(row)
        if held:
            put(held)
        return Written(lines)

    def commit(self, messages: list[Written | None]) -> None:
        """A batch counts once its manifest is there, so tasks that were tried twice leave no rows twice."""
        fs, root = opened(self.where)
        fs.create_dir(root, recursive=True)
        text = "".join(json.dumps(x) + "\n" for m in messages if m for x in m.lines)
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}") as f:
            f.write(text.encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.where)
        for m in messages:
            for x in m.lines if m else []:
                fs.delete_file(f"{root}/{x['name']}")


class Snapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("rows", BATCH)))


def written(files: DataFrame, where: str | None = None, rows: int = BATCH) -> str:
    """Adds files (revision, path, text; none of the first two null) to a store, a new one by default, in batches of `rows`; returns its folder."""
    spark = files.sparkSession
    spark.dataSource.register(Snapshots)
    where = where or f"{scratch_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    kept = files.filter("revision IS NOT NULL AND path IS NOT NULL").select("revision", "path", "text")
    kept.repartitionByRange("revision", "path").sortWithinPartitions("revision", "path").write.format("snapshots").option("rows", rows).mode("append").save(where)
    return where


def read(spark: SparkSession, where: str) -> DataFrame:
    spark.dataSource.register(Snapshots)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("snapshots").load(where)
