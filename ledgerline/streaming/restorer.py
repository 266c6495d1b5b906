"""Restoring aliases in answers that arrive in pieces: any cut of the same text gives the same result.

A lane (stream and choice) holds back only the end of its text that may be the beginning of an alias. A
hold that grows too old, by the time in the rows, is let go as it is or waited for, as the policy says.
Frames without text wait behind the text that was written before them: while any lane of their stream
holds something back, or an earlier frame waits, they stay in line.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ledgerline.streaming.ordered import SHIFT

HOLD_MS = 40
OUT = StructType([StructField("lane", StringType()), StructField("seq", LongType()), StructField("text", StringType()), StructField("final", BooleanType()), StructField("silent", BooleanType())])
STATE = StructType([StructField("held", StringType()), StructField("since", LongType()), StructField("seq", LongType())])


@dataclass
class Hold:
    """The held end of a lane, and the aliases that are restored in it."""

    originals: dict[str, str]
    held: str = ""
    since: int | None = None
    restored: int = 0
    partial: int = 0
    starts: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.starts = {a[:i] for a in self.originals for i in range(1, len(a))}
        self.longest = max(map(len, self.originals), default=0)

    def push(self, text: str, now: int) -> str:
        """The text that can be told after one more piece."""
        body, out, at = self.held + text, [], 0
        while at < len(body):
            rest = body[at : at + self.longest]
            # A longer alias may still come: wait if all that is left begins one.
            if at + len(rest) == len(body) and rest in self.starts:
                break
            hit = next((rest[:n] for n in range(len(rest), 0, -1) if rest[:n] in self.originals), None)
            if hit:
                out.append(self.originals[hit])
                self.restored += 1
                at += len(hit)
            else:
                out.append(body[at])
                at += 1
        left = body[at:]
        self.since = None if not left else now if self.since is None or left != self.held else self.since
        self.held = left
        return "".join(out)

    def tick(self, now: int, wait: bool = False) -> str:
        """What a hold that is too old lets go."""
        if self.held and not wait and self.since is not None and now - self.since >= HOLD_MS:
            return self.flush()
        return ""

    def flush(self) -> str:
        """All that is held, with whole aliases restored, at an end or an error."""
        body, out = self.held, []
        self.held, self.since = "", None
        while body:
            hit = next((body[:n] for n in range(len(body), 0, -1) if body[:n] in self.originals), None)
            out.append(self.originals[hit] if hit else body[0])
            self.restored += bool(hit)
            body = body[len(hit) if hit else 1 :]
        self.partial += 1
        return "".join(out)


class Frames:
    """Server-sent frames from pieces of bytes: each ends with an empty line; what is left at the end is told apart."""

    def __init__(self) -> None:
        self.rest = b""

    def push(self, piece: bytes) -> list[bytes]:
        self.rest += piece
        out = []
        while True:
            ends = [(i, len(mark)) for mark in (b"\n\n", b"\r\n\r\n") if (i := self.rest.find(mark)) >= 0]
            if not ends:
                return out
            at, size = min(ends)
            out.append(self.rest[:at])
            self.rest = self.rest[at + size :]


def frame_data(frame: bytes) -> dict | str | None:
    """The data of a frame: an object, the text [DONE], or none."""
    lines = [line[5:].strip() for line in frame.replace(b"\r\n", b"\n").split(b"\n") if line.startswith(b"data:")]
    text = b"\n".join(lines).decode("utf-8", "replace")
    if not text or text == "[DONE]":
        return text or None
    try:
        return json.loads(text)
    except ValueError:
        return None


def restore_frames(pieces: Iterable[bytes], originals: dict[str, str]) -> list[tuple[int, str]]:
    """(lane, text) of a whole stream of pieces, one entry per lane: its restored text."""
    frames, lanes, out = Frames(), {}, {}
    for piece in pieces:
        for frame in frames.push(piece):
            data = frame_data(frame)
            for choice in data.get("choices", []) if isinstance(data, dict) else []:
                lane, text = int(choice.get("index", 0)), (choice.get("delta") or {}).get("content")
                if isinstance(text, str):
                    own = lanes.setdefault(lane, Hold(originals))
                    out[lane] = out.get(lane, "") + own.push(text, 0)
    for lane, own in lanes.items():
        out[lane] += own.flush()
    return sorted(out.items())


class Line:
    """One stream's frames in their order: text of lanes, and frames without text that may not pass held text."""

    def __init__(self, originals: dict[str, str]) -> None:
        self.originals, self.lanes, self.waiting = originals, {}, []

    def _released(self) -> list[tuple[str | None, str]]:
        if any(own.held for own in self.lanes.values()):
            return []
        out, self.waiting = [(None, frame) for frame in self.waiting], []
        return out

    def push(self, lane: str | None, text: str, now: int) -> list[tuple[str | None, str]]:
        """(lane, text) that can be told after one more frame; a frame without a lane passes as it is."""
        if lane is None:
            self.waiting.append(text)
            return self._released()
        own = self.lanes.setdefault(lane, Hold(self.originals))
        told = own.tick(now) + own.push(text, now)
        return ([(lane, told)] if told else []) + self._released()

    def flush(self) -> list[tuple[str | None, str]]:
        """What lanes hold, by their first appearance, then the frames that waited."""
        told = [(lane, own.flush()) for lane, own in self.lanes.items() if own.held]
        return told + self._released()


def ordered_frames(frames: DataFrame, originals: dict[str, str]) -> DataFrame:
    """(stream, place, lane, text) of finished streams of frames (stream, seq, now_ms, lane: null without text, text), in the order in which they go out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, own in zip(batch["stream"], batch["own"], strict=True):
                line, told = Line(originals), []
                for frame in own:
                    told += line.push(frame["lane"], frame["text"] or "", int(frame["now_ms"]))
                out += [(stream, k, lane, text) for k, (lane, text) in enumerate(told + line.flush())]
            yield pd.DataFrame(out, columns=["stream", "place", "lane", "text"])

    own = F.sort_array(F.collect_list(F.struct("seq", "now_ms", "lane", "text"))).alias("own")
    return frames.groupBy("stream").agg(own).mapInPandas(run, "stream long, place long, lane string, text string")


class Restorer(StatefulProcessor):
    """The state of a lane: what it holds back and since when, and the number of its last chunk."""

    def __init__(self, originals: dict[str, str], wait: bool) -> None:
        self.originals, self.wait = originals, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", STATE)

    def _load(self) -> tuple[Hold, int | None]:
        held, since, _ = self.state.get() if self.state.exists() else ("", None, None)
        return Hold(self.originals, held, since), since

    def _save(self, own: Hold, seq: int, timer: int | None) -> None:
        """Keep what is held, with a timer at the end of its patience in place of the one before."""
        if timer is not None and timer != own.since and not self.wait:
            self.handle.deleteTimer(timer + HOLD_MS + SHIFT)
        if not own.held:
            self.state.clear()
            return
        self.state.update((own.held, own.since, seq))
        if timer != own.since and not self.wait:
            self.handle.registerTimer(own.since + HOLD_MS + SHIFT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, timer = self._load()
        out, seq = [], None
        for seq, now, text, last in pd.concat(list(rows)).sort_values("seq")[["seq", "now_ms", "text", "last"]].itertuples(index=False):
            told = own.tick(int(now), self.wait) + own.push(text or "", int(now))
            told += own.flush() if last else ""
            out.append((key[0], int(seq), told, bool(last), False))
        self._save(own, int(seq), timer)
        yield pd.DataFrame(out, columns=OUT.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A lane that fell silent: what it holds is let go, with the number of its last chunk."""
        own, _ = self._load()
        out = []
        if own.held and own.since + HOLD_MS + SHIFT <= timerValues.getCurrentWatermarkInMs():
            out = [(key[0], self.state.get()[2], own.flush(), False, True)]
            self.state.clear()
        yield pd.DataFrame(out, columns=OUT.names)

    def close(self) -> None:
        pass


def restored_stream(chunks: DataFrame, originals: dict[str, str], wait: bool = False, delay: str = "10 seconds") -> DataFrame:
    """lane, seq, text, final and silent (whether a timer let it go) of a stream of chunks (lane, seq, now_ms, text, last); originals are those of the request's snapshot. A lane's state goes with its last chunk.

    now_ms is when the chunk arrived. A lane that falls silent is let go by a timer once the watermark, now_ms of any
    lane less the delay, is HOLD_MS past the time of what it holds; by Spark's rule a chunk that is read more
    than the delay after later ones have been is dropped, so the delay must exceed the disorder of the source. With wait, nothing is let go.
    """
    stamped = chunks.withColumn("arrived", F.timestamp_millis(F.col("now_ms") + SHIFT)).withWatermark("arrived", delay)
    return stamped.groupBy("lane").transformWithStateInPandas(statefulProcessor=Restorer(originals, wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
