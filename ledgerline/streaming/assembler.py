"""Flows from a stream of kernel events, one state per key.

A flow is given out when it closes, or when a row of kind 'drain' says that its key is to be sealed; so a
flow is never split by the batch it happens to fall in, only where the stream itself says so. Volume and
close without an open flow are orphans; their count is given out with the key's next row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_STATE = StructType([StructField(n, LongType()) for n in ("incarnation", "connected_at", "volumes", "bytes", "orphans")] + [StructField("live", BooleanType())])
OUT = StructType([StructField(n, LongType()) for n in ("key", "incarnation", "connected_at", "volumes", "bytes")] + [StructField("closed", BooleanType()), StructField("orphans", LongType())])
_FRESH = (0, None, 0, 0, 0, False)
_READ = ["at", "event_id", "kind", "bytes"]


def step(state: tuple, at: int, kind: str, size: int) -> tuple[tuple, tuple | None]:
    """The state after one event, and the row that it gives out: (incarnation, connected_at, volumes, bytes, closed, orphans)."""
    life, since, volumes, total, orphans, live = state
    if kind == "connect":
        return (life, at, volumes, total, orphans, True), None
    if kind == "volume":
        return ((life, since, volumes + 1, total + size, orphans, True) if live else (life, since, volumes, total, orphans + 1, False)), None
    if kind == "drain":
        row = rest(state)
        return (life + (row is not None), None, 0, 0, 0, False), row
    lost = orphans + (not live)
    return (life + 1, None, 0, 0, 0, False), (life, since, volumes, total, live, lost)


def rest(state: tuple) -> tuple | None:
    """The row of a key that is sealed."""
    life, since, volumes, total, orphans, live = state
    return (life, since, volumes, total, False, orphans) if live or orphans else None


def assemble(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """The flows of one key that a batch's events end; the key's state goes with the events to the task and back."""
    state, out = tuple(held.get) if held.exists else _FRESH, []
    columns = [[v for column in own for v in column] for own in zip(*([part[c].tolist() for c in _READ] for part in parts), strict=True)]
    for at, _, kind, size in sorted(zip(*columns, strict=True), key=lambda r: r[:2]):
        state, row = step(state, at, kind, size)
        out += [(key[0], *row)] if row else []
    held.update(state)
    if out:
        yield pd.DataFrame(out, columns=OUT.names)


def assembled_stream(events: DataFrame) -> DataFrame:
    """Flows of a stream (key, at, event_id, kind, bytes); needs the RocksDB state store."""
    return events.groupBy("key").applyInPandasWithState(assemble, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
