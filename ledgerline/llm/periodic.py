"""Periodic runs of words, found by partition refinement.

A run is a stretch of consecutive words with a smallest period q, at least EXPONENT * q words and LEAST words long,
that no neighbouring word extends with that period.

The places of a block of texts are kept in classes of equal factors of length L, L growing from 1. A class of length L + 1
holds the places of one class of length L whose next places are in one class of length L, too; so
classes are split by those that were made at the length before, all but the largest part of each split class (the smaller
halves): a place is moved a logarithmic number of times. When two neighbouring members of a class stand L apart, a square with
the primitive root of L words begins at the first. Squares of one length at consecutive places are one run.

A run of exponent e shows e - 1 members of every class that its squares begin in, so classes with fewer members are
given up, and so is every place before a place that was. All texts of a block are refined together, and
their classes never mix. A text takes O(n log n) moves whatever its periods.

Defined results: words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return,
in their own case; null, empty and wordless texts have no runs and collapse to an empty text; repeated rows each have their
result; texts of any length are whole; an empty table gives an empty result; ids may be null or repeated; other
columns may have any names and are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

EXPONENT = 4
LEAST = 6
#: Words of a block of texts that are refined together; a longer text is a block of its own.
BLOCK_WORDS = 300_000


class _Classes:
    """Classes of places, each a piece of one array and a chain in order of place; class -1 holds the places given up."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, members: int):
        """codes: the words' numbers, text by text; each text is followed by an end, a place that is given up from the start."""
        self.members = members
        texts = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(codes)) + texts
        size = len(codes) + len(lengths)
        key = texts * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(order)))
        keep = count >= members
        held = order[np.repeat(keep, count)]
        self.slots = place[held]
        self.count = count[keep]
        self.begin = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.used = len(self.count)
        of = np.repeat(np.arange(self.used), self.count)
        self.cls = np.full(size, -1, np.int64)
        self.cls[self.slots] = of
        self.slot = np.zeros(size, np.int64)
        self.slot[self.slots] = np.arange(len(self.slots))
        self.next, self.prev = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self._chain(self.slots, of)
        self.mark = np.zeros(size, bool)
        self.dead = np.flatnonzero(self.cls < 0)
        # All classes but the largest of each text split first.
        text_of = texts[held[self.begin]] if self.used else np.zeros(0, np.int64)
        small = np.ones(self.used, bool)
        if self.used:
            by = np.lexsort((self.count, text_of))
            small[by[np.append(text_of[by][1:] != text_of[by][:-1], True)]] = False
        self.split, self.label = self._members(np.flatnonzero(small))

    def _chain(self, places: np.ndarray, of: np.ndarray) -> None:
        """Link places, which stand in order within each class."""
        if len(places):
            same = of[1:] == of[:-1]
            self.next[places] = np.append(np.where(same, places[1:], -1), -1)
            self.prev[places] = np.append(-1, np.where(same, places[:-1], -1))

    def _members(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[classes]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.slots[np.repeat(self.begin[classes], n) + within], np.repeat(classes, n)

    def _grow(self, more: int) -> np.ndarray:
        ids = np.arange(self.used, self.used + more)
        self.used += more
        while self.used > len(self.begin):
            room = np.zeros(max(len(self.begin), 64), np.int64)
            self.begin, self.count = np.concatenate([self.begin, room]), np.concatenate([self.count, room])
        return ids

    def refine(self) -> np.ndarray | None:
        """Go to the next length. Gives the places whose distance to the next member changed, or None if no place is left."""
        by = np.concatenate([self.dead, self.split])
        label = np.concatenate([np.full(len(self.dead), -1, np.int64), self.label])
        moved = by - 1
        able = (moved >= 0) & (self.cls[moved] >= 0)
        moved, label = moved[able], label[able]
        nothing = np.zeros(0, np.int64)
        self.dead = self.split = self.label = nothing
        if not len(moved):
            return None
        own = self.cls[moved]
        order = np.lexsort((moved, label, own))
        moved, label, own = moved[order], label[order], own[order]
        new_class = np.append(True, own[1:] != own[:-1])
        new_part = new_class | np.append(True, label[1:] != label[:-1])
        part, cls = np.cumsum(new_part) - 1, np.cumsum(new_class) - 1
        size = np.bincount(part)
        touched = own[new_class]
        rest = self.count[touched] - np.bincount(cls)
        # A class that goes over as a whole into one part isn't split.
        head = np.flatnonzero(new_part)
        whole = (rest[cls[head]] == 0) & (np.bincount(cls[head])[cls[head]] == 1) & (label[head] >= 0)
        if whole.any():
            stays = ~whole[part]
            moved, label, own = moved[stays], label[stays], own[stays]
            if not len(moved):
                return nothing
            new_class = np.append(True, own[1:] != own[:-1])
            new_part = new_class | np.append(True, label[1:] != label[:-1])
            part, cls = np.cumsum(new_part) - 1, np.cumsum(new_class) - 1
            size = np.bincount(part)
            touched = own[new_class]
            rest = self.count[touched] - np.bincount(cls)
            head = np.flatnonzero(new_part)
        gone = np.bincount(cls)
        # Take the moved places out of their chains: a stretch of moved neighbours is bridged at once.
        self.mark[moved] = True
        chain = moved[np.lexsort((moved, own))]
        before, after = self.prev[chain], self.next[chain]
        left = before[(before < 0) | ~self.mark[before]]
        right = after[(after < 0) | ~self.mark[after]]
        self.next[left[left >= 0]] = right[left >= 0]
        self.prev[right[right >= 0]] = left[right >= 0]
        changed = [left[(left >= 0) & (right >= 0)]]
        # Bring them to the front of their class's piece.
        front = np.repeat(self.begin[touched], gone) + np.arange(len(moved)) - np.repeat(np.cumsum(gone) - gone, gone)
        where = self.slot[moved]
        beyond = np.sort(where[where >= (self.begin[touched] + gone)[cls]])
        inside = self.slots[front]
        inside = inside[~self.mark[inside]]
        if len(inside):
            by_class = np.argsort(self.cls[self.slots[beyond]], kind="stable")
            beyond = beyond[by_class]
            self.slots[beyond] = inside
            self.slot[inside] = beyond
        self.slots[front] = moved
        self.slot[moved] = front
        self.mark[moved] = False
        self.begin[touched] += gone
        self.count[touched] = rest
        # Parts with enough members are classes; the others, and what is left of a class with too few, are given up.
        lives = (label[head] >= 0) & (size >= self.members)
        ids = np.full(len(head), -1, np.int64)
        ids[lives] = self._grow(int(lives.sum()))
        self.begin[ids[lives]] = front[head[lives]]
        self.count[ids[lives]] = size[lives]
        self.cls[moved] = ids[part]
        kept = lives[part]
        if kept.any():
            self._chain(moved[kept], ids[part][kept])
            changed.append(moved[kept])
        few = touched[(rest > 0) & (rest < self.members)]
        lost, _ = self._members(few)
        self.cls[lost] = -1
        self.count[few] = 0
        self.dead = np.concatenate([moved[~kept], lost])
        # The largest part of a class doesn't split others.
        parts = np.flatnonzero(lives)
        if len(parts):
            rest = np.where(rest >= self.members, rest, 0)
            of = cls[head[parts]]
            best = rest.copy()
            np.maximum.at(best, of, size[parts])
            largest = np.full(len(touched), -1, np.int64)
            fits = size[parts] == best[of]
            largest[of[fits]] = parts[fits]
            stays = rest == best
            largest[stays] = -1
            small = parts[largest[of] != parts]
            over = np.flatnonzero(~stays & (rest > 0) & (np.bincount(of, minlength=len(touched)) > 0))
            self.split, self.label = self._members(np.concatenate([ids[small], touched[over]]))
        return np.concatenate(changed)


def find_runs(codes: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of texts whose words are given as numbers, by text, start and period."""
    classes = _Classes(codes, lengths, exponent - 1)
    firsts = np.cumsum(lengths + 1) - (lengths + 1)
    longest = int(lengths.max(initial=0)) // exponent
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    changed: np.ndarray | None = np.zeros(0, np.int64)
    due: dict[int, list[np.ndarray]] = {}
    length, until = 1, 1
    while changed is not None and length <= longest:
        if length == until:
            # Distances that matter up to twice this length: those of today here, those that change meanwhile below.
            until, due = 2 * length, {}
            changed = np.flatnonzero((classes.cls >= 0) & (classes.next >= 0))
        gaps = classes.next[changed] - changed
        soon = (gaps >= length) & (gaps < until)
        if soon.any():
            places, gaps = changed[soon], gaps[soon]
            order = np.argsort(gaps, kind="stable")
            places, gaps = places[order], gaps[order]
            cuts = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
            for g, some in zip(gaps[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                due.setdefault(g, []).append(some)
        if length in due:
            squares = np.unique(np.concatenate(due.pop(length)))
            squares = squares[(classes.cls[squares] >= 0) & (classes.next[squares] - squares == length)]
            if len(squares):
                begins = np.flatnonzero(np.append(True, np.diff(squares) != 1))
                whole = np.diff(np.append(begins, len(squares))) - 1 + 2 * length
                enough = whole >= max(least, exponent * length)
                if enough.any():
                    found.append((squares[begins[enough]], whole[enough], length))
        changed = classes.refine()
        length += 1
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start = np.concatenate([f[0] for f in found])
    whole = np.concatenate([f[1] for f in found])
    period = np.concatenate([np.full(len(f[0]), f[2], np.int64) for f in found])
    text = np.searchsorted(firsts, start, "right") - 1
    order = np.lexsort((period, start, text))
    return text[order], (start - firsts[text])[order], whole[order], period[order]


def _block(texts: list[list[bytes]], exponent: int, least: int) -> tuple[tuple[np.ndarray, ...], list[bytes]]:
    """The runs of texts given as words, and the texts without the repeats of their runs."""
    number: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(lengths.sum()))
    runs = find_runs(codes, lengths, exponent, least)
    text, start, length, period = runs
    first = np.cumsum(lengths) - lengths
    steps = np.zeros(len(codes) + 1, np.int64)
    np.add.at(steps, first[text] + start + period, 1)
    np.add.at(steps, first[text] + start + length, -1)
    kept = np.cumsum(steps)[:-1] == 0
    has = np.zeros(len(texts), bool)
    has[text] = True
    return runs, [b" ".join(compress(t, kept[first[k] : first[k] + len(t)].tolist())) if has[k] else b" ".join(t) for k, t in enumerate(texts)]


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; in words, by start, then period) and collapsed (the text without repeats) of every row of docs (doc_id, text).

    The collapsed text has every word but those that stand in a run after its first period, joined by one space.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            held: list[list[bytes]] = []
            begin = size = 0
            for k in range(batch.num_rows):
                held.append((texts[k].as_py() or b"").split())
                size += len(held[-1])
                if size >= BLOCK_WORDS or k == batch.num_rows - 1:
                    (text, *parts), short = _block(held, exponent, least)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(text, np.arange(len(held) + 1)).astype(np.int32)),
                        pa.StructArray.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["start", "length", "period"]),
                    )
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), lists, pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
                    held, begin, size = [], k + 1, 0

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(found, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
