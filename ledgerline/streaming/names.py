"""The names of an address as a stream's state: answers extend them, flows read them, time lets go of them.

Rows of one second of an address are gathered before, by Spark's own aggregation, and come when the watermark has passed
them; so no row waits in Python, and a name's answers and the flows of a second are dealt with once, however many there are.
The state of an address is a map of its names to when they expire, as large as its capacity at most: a name
that finds no room is not held, and flows that it would have named say so. When all names of an address have
expired, its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ledgerline.streaming.ordered import SHIFT, stamped

#: Names that an address has at most.
NAMES = 32
#: Moments whose flows are given out at once.
MOMENTS = 1000


class NameTable(StatefulProcessor):
    """Rows (at_ms, flows, told: pairs of name and ttl), one a moment; answers of a moment come before its flows. A timer stands where the last name expires."""

    out = StructType([StructField("ip", StringType()), StructField("flows", ArrayType(StringType())), StructField("at_ms", LongType()), StructField("dns_names", ArrayType(StringType())), StructField("names_dropped", BooleanType())])

    def __init__(self, least: int, most: int, names: int) -> None:
        self.least, self.most, self.names = least, most, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getMapState("names", StructType([StructField("name", StringType())]), StructType([StructField("until", LongType())]))
        self.refused = handle.getValueState("refused", StructType([StructField("until", LongType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def load(self) -> None:
        self.held = {k[0]: v[0] for k, v in self.table.iterator()} if self.table.exists() else {}
        self.kept = dict(self.held)
        self.lost = self.lost_before = self.refused.get()[0] if self.refused.exists() else 0
        self.timer_before = self.timer.get()[0] if self.timer.exists() else None

    def tell(self, at: int, name: str, until: int) -> None:
        if name not in self.held and len(self.held) >= self.names:
            self.held = {n: u for n, u in self.held.items() if u > at}
        if name in self.held or len(self.held) < self.names:
            self.held[name] = max(until, self.held.get(name, 0))
        else:
            self.lost = max(self.lost, until)

    def moment(self, at: int, flows: list[str], told: list) -> tuple | None:
        """What one moment gives out: its flows with the names that hold."""
        for name, ttl in sorted((r["name"], r["ttl"]) for r in told):
            self.tell(at, name, at + 1000 * min(max(ttl, self.least), self.most))
        return (flows, at, sorted(n for n, until in self.held.items() if until > at), self.lost > at) if len(flows) else None

    def expires(self) -> int | None:
        return max([*self.held.values(), self.lost], default=0) or None

    def expire(self, now: int) -> None:
        self.held = {n: u for n, u in self.held.items() if u > now}
        self.lost = self.lost if self.lost > now else 0

    def save(self) -> None:
        for name in self.kept.keys() - self.held.keys():
            self.table.removeKey((name,))
        for name, until in self.held.items():
            if self.kept.get(name) != until:
                self.table.updateValue((name,), (until,))
        if self.lost != self.lost_before:
            self.refused.update((self.lost,))
        at = self.expires()
        if at == self.timer_before:
            return
        if self.timer_before is not None:
            self.handle.deleteTimer(self.timer_before + SHIFT)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at + SHIFT)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        moments = sorted((r for part in rows for r in zip(part["at_ms"].tolist(), part["flows"], part["told"], strict=True)), key=lambda r: r[0])
        for k in range(0, len(moments), MOMENTS):
            out = [(key[0], *o) for r in moments[k : k + MOMENTS] if (o := self.moment(*r))]
            yield pd.DataFrame(out, columns=self.out.names)
        self.expire(timerValues.getCurrentWatermarkInMs() - SHIFT)
        self.save()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        self.load()
        self.expire(timerValues.getCurrentWatermarkInMs() - SHIFT)
        self.save()
        yield pd.DataFrame([], columns=self.out.names)

    def close(self) -> None:
        pass


def named_stream(flows: DataFrame, answers: DataFrame, delay: str = "60 seconds", least: int = 30, most: int = 3600, names: int = NAMES) -> DataFrame:
    """ip, flow_id, at_ms, dns_names and names_dropped of a stream of flows (flow_id, dst_ip, at) and one of answers (ip, name, at, ttl); times are seconds.

    A flow is given out once no answer of its time can come any more.
    """
    none = lambda kind: F.lit(None).cast(kind)
    ms = (F.col("at") * 1000).cast("long").alias("at_ms")
    asked = flows.filter("dst_ip is not null and at is not null").select(F.col("dst_ip").alias("ip"), ms, F.col("flow_id").cast("string").alias("flow"), none("string").alias("name"), none("long").alias("ttl"))
    told = answers.filter("ip is not null and name is not null").select("ip", ms, none("string").alias("flow"), "name", F.coalesce(F.col("ttl").cast("long"), F.lit(least)).alias("ttl"))
    flow, answer = F.when(F.col("flow").isNotNull(), F.col("flow")), F.when(F.col("name").isNotNull(), F.struct("name", "ttl"))
    moments = stamped(asked.unionByName(told), "at_ms", delay).groupBy("ip", "__time").agg(F.first("at_ms").alias("at_ms"), F.collect_list(flow).alias("flows"), F.collect_set(answer).alias("told"))
    named = moments.groupBy("ip").transformWithStateInPandas(statefulProcessor=NameTable(least, most, names), outputStructType=NameTable.out, outputMode="Append", timeMode="EventTime")
    return named.select("ip", F.explode("flows").alias("flow_id"), "at_ms", "dns_names", "names_dropped")
