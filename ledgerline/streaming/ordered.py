"""State that sees each key's rows in the order of their time, whatever cut the stream comes in.

A row waits until the watermark has passed its time, so that no earlier one can come; then it is applied. A
timeout stands at the earliest row that waits, or at the time at which what a key holds expires; so keys that fall
silent are settled too. Rows later than the watermark's delay are dropped by Spark. What a key holds and the rows
that wait go to the task with the key's rows and back, so a key costs no calls; this is for many keys of few rows each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Rows are stamped so many milliseconds later: a watermark begins at 0, and rows that aren't after it are dropped.
SHIFT = 1


def plain(rows: pd.DataFrame, fields: StructType) -> list[tuple]:
    """Rows of a pandas table as plain Python; whole numbers beside nulls come as floats and are made whole again."""
    columns = []
    for f in fields.fields:
        kind = int if isinstance(f.dataType, LongType) else lambda v: v.item() if hasattr(v, "item") else v
        columns.append([None if v is None or v is pd.NA or v != v else kind(v) for v in rows[f.name].tolist()])
    return list(zip(*columns, strict=True))


class InOrder:
    """Rows of `fields`, the first of which is their time in milliseconds; the others break ties. A subclass says what a row does, and keeps `kept`."""

    fields: StructType
    kept: StructType
    out: StructType

    def load(self, held: tuple | None) -> None:
        """Take what was kept of the key; None for a new one."""

    def apply(self, row: tuple) -> list[tuple]:
        """What a row gives out."""
        raise NotImplementedError

    def expires(self) -> int | None:
        """The time at which what the key holds expires."""

    def expire(self, now: int) -> list[tuple]:
        """What is given out when the watermark has come to now and no row waits before it."""
        return []

    def save(self) -> tuple:
        """What is kept of the key."""
        raise NotImplementedError

    def settle(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        *held, waiting = state.get if state.exists else (None, [])
        rows = [tuple(r) for r in waiting]
        if not state.hasTimedOut:
            rows += [r for part in parts for r in plain(part, self.fields)]
        rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
        due = bisect_right(rows, watermark - SHIFT, key=lambda r: r[0])
        self.load(tuple(held) if state.exists else None)
        out = [o for r in rows[:due] for o in self.apply(r)] + self.expire(watermark - SHIFT)
        state.update((*self.save(), rows[due:]))
        at = rows[due][0] if due < len(rows) else self.expires()
        if at is not None:
            # Spark times out when the watermark is beyond this, and wants it beyond the watermark.
            state.setTimeoutTimestamp(max(at + SHIFT - 1, watermark + 1))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.out.names)


def stamped(rows: DataFrame, at_ms: str, delay: str) -> DataFrame:
    """rows with their event time, in milliseconds, as __time, which has a watermark."""
    return rows.withColumn("__time", F.timestamp_millis(F.col(at_ms) + SHIFT)).withWatermark("__time", delay)


def in_order(rows: DataFrame, key: str, processor: InOrder, delay: str) -> DataFrame:
    """What a processor gives out for a stream of rows (key and the processor's fields); needs the RocksDB state store."""
    timed = stamped(rows.select(key, *processor.fields.names), processor.fields.names[0], delay)
    state = StructType([*processor.kept.fields, StructField("waiting", ArrayType(processor.fields))])
    return timed.groupBy(key).applyInPandasWithState(processor.settle, processor.out, state, "append", GroupStateTimeout.EventTimeTimeout)
