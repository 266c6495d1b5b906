"""Event lines written as streams of files, each with its status: a Spark data source for batches and for Structured Streaming.

A task writes one stream, `<name>.jsonl`. It keeps the newest `ring` lines of what it is given, and
counts those it lets go; the sidecar `<name>.jsonl.status.json` tells both numbers, so that a reader knows what it does not see.
Files appear only on commit: tasks write under hidden names, which a commit renames to names made of the batch's and the
task's number. A batch that is committed again replaces its own files, so nothing is added twice.

    spark.dataSource.register(HookSink)
    lines.write.format("hook_jsonl").option("path", folder).option("window_ms", 60000).mode("append").save()
    lines.writeStream.format("hook_jsonl").option("path", folder).option("checkpointLocation", ...).start()
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: Lines that a stream keeps, where the option doesn't say.
RING = 1024


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote under a hidden name."""

    hidden: str
    task: int


def _folder(path: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ring, self.window = options["path"].rstrip("/"), int(options.get("ring", RING)), int(options.get("window_ms", 0))

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        store, folder = _folder(self.path)
        hidden = f".{uuid.uuid4().hex}"
        kept: deque[str] = deque(maxlen=self.ring)
        seen = 0
        for row in iterator:
            kept.append(row[0])
            seen += 1
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{hidden}.jsonl") as f:
            for line in kept:
                f.write(line.encode() + b"\n")
        status = {"hook_status": "active", "dropped_events_count": seen - len(kept), "written_events_count": len(kept), "failures": [], "observation_window_ms": self.window}
        with store.open_output_stream(f"{folder}/{hidden}.status") as f:
            f.write(json.dumps(status).encode())
        return Written(hidden, TaskContext.get().partitionId())

    def publish(self, messages: list[Written | None], batch: str) -> None:
        """Rename what the tasks wrote; the files of an earlier commit of the same batch go."""
        from pyarrow import fs

        store, folder = _folder(self.path)
        names = {m.task: f"hook-{batch}-{m.task:05d}.jsonl" for m in messages if m is not None}
        wanted = {n for name in names.values() for n in (name, f"{name}.status.json")}
        for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if old.base_name.startswith(f"hook-{batch}-") and old.base_name not in wanted:
                store.delete_file(old.path)
        for m in messages:
            if m is not None:
                # The status first, so that no stream is ever seen without it.
                store.move(f"{folder}/{m.hidden}.status", f"{folder}/{names[m.task]}.status.json")
                store.move(f"{folder}/{m.hidden}.jsonl", f"{folder}/{names[m.task]}")

    def withdraw(self, messages: list[Written | None]) -> None:
        store, folder = _folder(self.path)
        for m in messages:
            for suffix in ("jsonl", "status") if m is not None else ():
                store.delete_file(f"{folder}/{m.hidden}.{suffix}")


class HookBatchWriter(_Writer, DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        super().__init__(options)
        self.overwrite, self.batch = overwrite, options.get("batch", uuid.uuid4().hex)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            from pyarrow import fs

            store, folder = _folder(self.path)
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.base_name.startswith("hook-"):
                    store.delete_file(old.path)
        self.publish(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.withdraw(messages)


class HookStreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{batchId:010d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.withdraw(messages)


class HookSink(DataSource):
    """Options: path, ring (lines that a task keeps), window_ms (how long was observed), batch (a name that makes a batch write repeatable)."""

    @classmethod
    def name(cls) -> str:
        return "hook_jsonl"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def writer(self, schema: StructType, overwrite: bool) -> HookBatchWriter:
        return HookBatchWriter(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> HookStreamWriter:
        return HookStreamWriter(self.options)


def event_lines(events: DataFrame) -> DataFrame:
    """One column, value: each row of events as a line of JSON without its null fields."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def write_hooks(lines: DataFrame, path: str, window_ms: int, ring: int = RING, batch: str | None = None) -> None:
    """Append lines (value) to the streams of a folder; a batch of the same name again adds nothing."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(HookSink)
    out = lines.write.format("hook_jsonl").option("path", path).option("ring", str(ring)).option("window_ms", str(window_ms))
    (out.option("batch", batch) if batch else out).mode("append").save()
