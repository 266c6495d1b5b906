"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is read as sequences of letter strings. Two strings are alike by the four-letter subsequences
that they share, gaps allowed: a subsequence that spans s letters counts DECAY**s, up to SPAN letters,
so inserted letters weaken a likeness but don't end it; signs inside a word are dropped, digits that
stand for letters are read as those, and letters written apart are joined. The strings are scaled by
their length, which keeps the kernel positive. Letters are code points: beyond a to z each is dealt to one of
a few classes by the number of its lower-case form, so that words of all scripts stay apart.

Training is on labelled sentences of a bounded sample of labelled documents, copies left out: strings that
set toxic documents apart beyond chance (a document's label is that of a bag) and gapped forms of them are
the positive cases, strings of clean documents the negative ones, the hardest added in rounds.
Landmarks span the feature space (Nystroem), a squared-hinge machine is solved there by Newton steps,
and the landmark expansion of its weight vector is folded into one table of subsequence weights, which
has a fixed size and gives the machine's exact value for any string. A sentence is as toxic as its worst
string and a document as its worst sentence; a logistic curve fitted on the sample makes that a score.

Defined results: null, empty and wordless texts get the score of a text without a toxic string; without
labels of both kinds every score is the share of toxic labels, 0 where there are none; repeated rows are
scored alike; a label that isn't 0 or 1, or whose document is missing, is ignored; rows with a null doc_id
are scored and count as held out, as they can't be named by a label; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

DECAY = 0.6
SPAN = 7
ORDER = 4
#: 0 marks a beginning, 1 to 26 are a to z, the rest are classes that other letters are dealt to.
LETTERS, LATIN = 40, 27
#: Documents of each label that the machine is trained on, at most.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 5000
LANDMARKS = 400
#: Training strings, at most: those that set toxic documents apart, those of clean documents, and the negative cases of the first round and added in each.
MARKS, CLEAN_STRINGS, FIRST_NEGATIVES, MORE_NEGATIVES = 1500, 60_000, 4000, 1500
#: Rows that are handed to Python at a time.
TEXTS_AT_ONCE = 512
#: Letters of a string that are compared; a longer one is read in overlapping pieces of this length.
LONGEST = 24

_SHAPES = [(0, *rest) for last in range(ORDER - 1, SPAN) for rest in combinations(range(1, last + 1), ORDER - 1) if rest[-1] == last]
_GAIN = np.array([DECAY ** (s[-1] + 1) for s in _SHAPES], np.float32)

#: What an ASCII byte is read as: 0 is dropped, 1 to 26 are letters, 255 is white space. Fixed values.
_READ = np.zeros(256, np.uint8)
_READ[97:123] = np.arange(1, 27)
_READ[65:91] = np.arange(1, 27)
for _from, _to in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
    _READ[ord(_from)] = ord(_to) - 96
_READ[[9, 10, 11, 12, 13, 32]] = 255
_INSIDE = np.ones(256, bool)
_INSIDE[255] = False


@lru_cache(maxsize=1)
def _points() -> np.ndarray:
    """What the code points up to U+FFFF are read as: letters by class, spaces, or nothing."""
    read = np.zeros(1 << 16, np.uint8)
    for point in range(0x80, 1 << 16):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            read[point] = _other(ord(chr(point).lower()[0]))
        elif kind[0] == "Z":
            read[point] = 255
    return read


def _other(point: int) -> int:
    return LATIN + (point * 2_654_435_761 >> 16) % (LETTERS - LATIN)


def _codes(data: np.ndarray) -> np.ndarray:
    """What each byte of UTF-8 text is read as; a longer sequence is read at its first byte."""
    code = _READ[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        first, (a, b, c) = wide[lead], (wide[lead + k] & 63 for k in (1, 2, 3))
        point = np.where(first < 0xE0, (first & 31) << 6 | a, np.where(first < 0xF0, (first & 15) << 12 | a << 6 | b, (first & 7) << 18 | a << 12 | b << 6 | c))
        far = (point >= 0x20000) & (point < 0x33480)  # ideographs beyond the first plane
        code[lead] = np.where(point < 1 << 16, _points()[np.minimum(point, 0xFFFF)], np.where(far, LATIN + (point * 2_654_435_761 >> 16) % (LETTERS - LATIN), 0))
    return code


def _length_scale() -> np.ndarray:
    """Square root of the summed squares of a string's subsequence weights, by its number of letters and the mark before them."""
    squares = np.zeros(LONGEST + 2)
    for shape, gain in zip(_SHAPES, _GAIN, strict=True):
        for n in range(len(squares)):
            squares[n] += max(0, n - shape[-1]) * float(gain) ** 2
    return np.sqrt(np.maximum(squares, 1e-9)).astype(np.float32)


_SCALE = _length_scale()


@dataclass
class Strings:
    """Letter strings, one after another, each after a 0 that marks its beginning."""

    letters: np.ndarray
    begins: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.begins)


def strings_of(words: list[np.ndarray]) -> Strings:
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=begins[1:])
    letters = np.zeros(begins[-1], np.int64)
    for b, w in zip(begins, words, strict=False):
        letters[b + 1 : b + 1 + len(w)] = w
    return Strings(letters, begins)


def _each_shape(x: Strings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions, subsequences there, weight) for each gap pattern."""
    n = len(x.letters)
    of = np.repeat(np.arange(len(x.begins) - 1), x.sizes())
    lead = x.letters * LETTERS**3
    by_last: dict[int, np.ndarray] = {}
    for shape, gain in zip(_SHAPES, _GAIN, strict=True):
        last = shape[-1]
        if last >= n:
            continue
        if last not in by_last:
            by_last[last] = np.flatnonzero(of[: n - last] == of[last:])
        at = by_last[last]
        if len(at):
            yield at, lead[at] + x.letters[at + shape[1]] * LETTERS**2 + x.letters[at + shape[2]] * LETTERS + x.letters[at + last], float(gain)


def table_values(x: Strings, table: np.ndarray) -> np.ndarray:
    """For each string the scaled sum of the table's weights of its subsequences."""
    if len(x.begins) == 1:
        return np.zeros(0, np.float32)
    per = np.zeros(len(x.letters), np.float32)
    for at, code, gain in _each_shape(x):
        per[at] += table[code] * np.float32(gain)
    return np.add.reduceat(per, x.begins[:-1]) / _SCALE[np.minimum(x.sizes(), LONGEST + 1)]


def kernel(x: Strings, landmarks: Strings) -> np.ndarray:
    """The kernel of every string with every landmark."""
    own = np.repeat(np.arange(len(landmarks.begins) - 1), landmarks.sizes())
    found = [(code, own[at], gain) for at, code, gain in _each_shape(landmarks)]
    codes = np.unique(np.concatenate([c for c, _, _ in found])) if found else np.zeros(0, np.int64)
    weights = np.zeros((len(codes) + 1, len(landmarks.begins) - 1), np.float32)
    place = np.full(LETTERS**ORDER, len(codes), np.int32)
    place[codes] = np.arange(len(codes), dtype=np.int32)
    for code, of, gain in found:
        np.add.at(weights, (place[code], of), gain)
    weights /= _SCALE[np.minimum(landmarks.sizes(), LONGEST + 1)]
    out = np.zeros((len(x.begins) - 1, weights.shape[1]), np.float32)
    of = np.repeat(np.arange(len(x.begins) - 1), x.sizes())
    for at, code, gain in _each_shape(x):
        hit = place[code]
        met = np.flatnonzero(hit < len(codes))
        for part in np.array_split(met, len(met) // 50_000 + 1):
            rows = of[at[part]]
            if len(rows):
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                out[rows[first]] += np.add.reduceat(weights[hit[part]] * np.float32(gain), first, axis=0)
    return out / _SCALE[np.minimum(x.sizes(), LONGEST + 1)][:, None]


def _letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that are read, with their rows' offsets, and the words' bounds in them, white space between."""
    code = _codes(data)
    kept = np.zeros(len(code) + 1, np.int64)
    np.cumsum(code != 0, out=kept[1:])
    return code[code != 0], kept[offs], *C.word_bounds(code[code != 0], kept[offs], _INSIDE)[:2]


def _spelled(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, code: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Runs of four or more words of one letter, each joined to a string; and their rows."""
    single = (ends - starts) == 1
    if len(single) < ORDER:
        return [], []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    words, rows = [], []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        for r in np.unique(row[a:b]) if b - a >= ORDER else ():
            run = code[starts[a:b][row[a:b] == r]]
            for k in range(0, max(1, len(run) - ORDER + 1), LONGEST // 2):
                if len(run[k : k + LONGEST]) >= ORDER:
                    words.append(run[k : k + LONGEST])
                    rows.append(int(r))
    return words, rows


def text_strings(data: np.ndarray, offs: np.ndarray) -> tuple[Strings, np.ndarray, np.ndarray]:
    """A chunk's distinct strings; and of every occurrence (string, row), grouped by row."""
    code, offs, starts, ends = _letters(data, offs)
    row = np.searchsorted(offs, starts, "right") - 1
    joined, joined_rows = _spelled(starts, ends, row, code)
    size = ends - starts
    long = np.flatnonzero(size > LONGEST)
    if len(long):  # pieces of LONGEST letters, half overlapping
        extra = [(starts[i] + k, min(starts[i] + k + LONGEST, ends[i]), row[i]) for i in long for k in range(0, size[i] - LONGEST // 2, LONGEST // 2)]
        more = np.array(extra, np.int64).reshape(-1, 3)
        keep = size <= LONGEST
        starts, ends, row = (np.concatenate([old[keep], more[:, k]]) for k, old in enumerate((starts, ends, row)))
        order = np.argsort(row, kind="stable")
        starts, ends, row = starts[order], ends[order], row[order]
        size = ends - starts
    fit = size >= ORDER - 1
    starts, row, size = starts[fit], row[fit], size[fit]
    if len(starts):
        up, down = C._power_tables(len(code))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)) * up[: len(code)], out=sums[1:])
        h = C.mix((sums[starts + size] - sums[starts]) * down[starts] ^ size.astype(np.uint64))
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        begins = np.zeros(len(one) + 1, np.int64)
        np.cumsum(size[one] + 1, out=begins[1:])
        inner = np.arange(begins[-1]) - np.repeat(begins[:-1], size[one] + 1)
        letters = np.where(inner == 0, 0, code[np.maximum(np.repeat(starts[one], size[one] + 1) + inner - 1, 0)]).astype(np.int64)
        found = Strings(letters, begins)
    else:
        found, which = Strings(np.zeros(0, np.int64), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    if joined:
        more = strings_of(joined)
        which = np.concatenate([which, len(found.begins) - 1 + np.arange(len(joined))])
        row = np.concatenate([row, np.array(joined_rows)])
        found = Strings(np.concatenate([found.letters, more.letters]), np.concatenate([found.begins, more.begins[1:] + found.begins[-1]]))
        order = np.argsort(row, kind="stable")
        which, row = which[order], row[order]
    return found, which, row


@dataclass
class Model:
    """table: subsequence weights; bias: the machine's; slope and level: the logistic curve's; prior: the score without a machine."""

    table: np.ndarray | None
    bias: float
    slope: float
    level: float
    prior: float

    def worst(self, column: pa.Array) -> np.ndarray:
        """Each text's largest machine value, -2 at least."""
        out = np.full(len(column), -2.0, np.float32)
        for at, n, data, offs in C.text_chunks(column):
            found, which, row = text_strings(data, offs)
            if len(row):
                values = (table_values(found, self.table) + np.float32(self.bias))[which]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[at + row[first]] = np.maximum(out[at + row[first]], np.maximum.reduceat(values, first))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.worst(column).astype(np.float64) + self.level)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _apart(bags: list[set[bytes]], toxic: np.ndarray) -> tuple[list[bytes], dict[bytes, list[int]]]:
    """Strings that set toxic bags apart, the most frequent first; and [toxic, clean] bags of every string.

    A string must be in so many toxic bags, and in hardly any clean one, that among all strings not one is
    expected to be so by chance.
    """
    counts: dict[bytes, list[int]] = {}
    for bag, t in zip(bags, toxic, strict=True):
        for s in bag:
            counts.setdefault(s, [0, 0])[1 - t] += 1
    several = sum(a + b > 1 for a, b in counts.values())
    least = max(2, int(np.ceil(np.log(max(several, 2)) / -np.log(toxic.mean()))))
    found = [s for s, (a, b) in counts.items() if a >= least and b * 20 <= a]
    return sorted(found, key=lambda s: (-counts[s][0], s)), counts


def _without_copies(bags: list[set[bytes]], bands: int = 5, width: int = 6) -> np.ndarray:
    """Numbers of the bags that share no band of minima with an earlier one: copies must not pass for evidence."""
    seen: set[tuple] = set()
    rng = np.random.default_rng(5)
    flip = rng.integers(0, 2**63, (bands * width, 1), dtype=np.uint64)
    keep = []
    for i, bag in enumerate(bags):
        h = np.fromiter((zlib.crc32(s) for s in bag), np.int64, len(bag)).view(np.uint64)
        low = C.mix(C.mix(h)[None, :] ^ flip).min(1) if len(h) else flip[:, 0]
        own = {(k, *low[k * width : (k + 1) * width].tolist()) for k in range(bands)}
        if not own & seen or not bag:
            keep.append(i)
        seen |= own
    return np.array(keep, np.int64)


def _gapped(word: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Forms of a string with a letter put in or doubled."""
    spots = rng.permutation(np.arange(1, len(word)))[:3]
    return [np.insert(word, k, rng.integers(1, 27)) for k in spots] + [np.insert(word, k, word[k]) for k in spots[:2]]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the bias last, of the squared-hinge machine, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    loss = lambda v: ridge * v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() / 2
    now = loss(w)
    for _ in range(60):
        own = y * (x @ w) < 1
        xs, cs = x[own], cost[own]
        lhs = (xs * cs[:, None]).T @ xs + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(lhs, xs.T @ (cs * y[own])) - w
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now * (1 - 1e-9):
            size /= 2
        after = loss(w + size * step)
        if now - after <= 1e-8 * now:
            break
        w, now = w + size * step, after
    return w


def fit(bags: list[set[bytes]], toxic: np.ndarray, prior: float) -> Model:
    """The model from labelled bags of strings (bytes of letter numbers)."""
    if not len(bags) or toxic.min() == toxic.max():
        return Model(None, 0.0, 0.0, 0.0, float(prior))
    whole, whole_toxic = bags, toxic
    keep = _without_copies(bags)
    bags, toxic = [bags[i] for i in keep], toxic[keep]
    if toxic.min() == toxic.max():
        return Model(None, 0.0, 0.0, 0.0, float(prior))
    marks, counts = _apart(bags, toxic)
    if not marks:
        return Model(None, 0.0, 0.0, 0.0, float(prior))
    marks = marks[:MARKS]
    seeds = marks[: LANDMARKS * 3 // 4]
    rng = np.random.default_rng(11)
    read = lambda s: np.frombuffer(s, np.uint8).astype(np.int64)
    clean = sorted(s for s, (_, b) in counts.items() if b >= 1 and s not in set(marks))
    clean = [clean[i] for i in rng.permutation(len(clean))[:CLEAN_STRINGS]]
    clean_strings = strings_of([read(s) for s in clean])
    positive = [read(s) for s in marks]
    bent = [v for s in seeds for v in _gapped(read(s), rng)]
    landmarks = strings_of([read(s) for s in seeds] + [read(s) for s in clean[: LANDMARKS - len(seeds)]])

    gram = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    pos = np.concatenate([kernel(strings_of(positive), landmarks), kernel(strings_of(bent), landmarks)]) @ root
    pos_cost = np.concatenate([np.full(len(positive), 30.0), np.full(len(bent), 10.0)])

    negative = set(range(min(FIRST_NEGATIVES, len(clean))))
    table = np.zeros(LETTERS**ORDER, np.float32)
    bias = 0.0
    own = np.repeat(np.arange(len(landmarks.begins) - 1), landmarks.sizes())
    for _ in range(4):
        use = sorted(negative)
        neg = kernel(strings_of([read(clean[i]) for i in use]), landmarks) @ root if use else np.zeros((0, root.shape[1]))
        w = _machine(np.concatenate([pos, neg]), np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]), np.concatenate([pos_cost, np.ones(len(neg))]))
        share = (root @ w[:-1]) / _SCALE[np.minimum(landmarks.sizes(), LONGEST + 1)]
        table[:] = 0
        for at, code, gain in _each_shape(landmarks):
            np.add.at(table, code, (share[own[at]] * gain).astype(np.float32))
        bias = float(w[-1])
        hard = np.argsort(-table_values(clean_strings, table))[:MORE_NEGATIVES] if len(clean) else []
        if set(map(int, hard)) <= negative:
            break
        negative |= set(map(int, hard))

    # The logistic curve over the bags' largest values, with the sample's shares of labels set right by weights.
    bags, toxic = whole, whole_toxic
    every = sorted(set().union(*bags)) if bags else []
    at = {s: i for i, s in enumerate(every)}
    parts = [table_values(strings_of([read(s) for s in every[at : at + 20_000]]), table) for at in range(0, len(every), 20_000)]
    values = np.concatenate(parts) + bias if parts else np.zeros(0)
    worst = np.array([max((values[at[s]] for s in bag), default=-2.0) for bag in bags], np.float64).clip(-2)
    weight = np.where(toxic == 1, max(prior, 1e-3) / toxic.mean(), (1 - min(prior, 1 - 1e-3)) / (1 - toxic.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * worst + b)))
        g = np.array([(weight * (p - toxic) * worst).sum() + 1e-2 * a, (weight * (p - toxic)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * worst**2).sum() + 1e-2, (s * worst).sum()], [(s * worst).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return Model(table, bias, float(max(a, 0.05)), float(b), float(prior))


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> Model:
    """The model from labelled rows that aren't held out: of each label a sample of bounded size, drawn by a hash of the doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    prior = total.t / total.n if total.n else 0.0
    drawn = [rows.filter(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, toxic_sample), (0, clean_sample))]
    sample = C.settle(drawn[0].union(drawn[1]), "tox-sample")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offs in C.text_chunks(batch.column(2)):
                found, which, row = text_strings(data, offs)
                raw = found.letters.astype(np.uint8).tobytes()
                words = [raw[b + 1 : e] for b, e in zip(found.begins, found.begins[1:], strict=False)]
                bags = [b"\xff".join(words[i] for i in np.unique(which[row == r])) for r in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(bags, pa.binary())], ["doc_id", "toxic", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    with C.small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        got = C.settle(texts.select("doc_id", "toxic", "text").mapInArrow(bag, "doc_id long, toxic int, bag binary"), "tox-bags")
    # One row a document, and documents with the same strings count once: copies must not pass for evidence.
    known: dict[bytes, bytes] = {}
    seen: set[int] = set()
    bags: list[set[bytes]] = []
    marks: list[int] = []
    for row in got.dropDuplicates(["doc_id"]).orderBy("doc_id").toLocalIterator():
        if zlib.crc32(row.bag) not in seen:
            seen.add(zlib.crc32(row.bag))
            bags.append({known.setdefault(s, s) for s in bytes(row.bag).split(b"\xff") if s})
            marks.append(row.toxic)
    del known
    model = fit(bags, np.array(marks, np.int64), prior)
    del bags
    C.trim_memory()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with C.small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        out = C.settle(texts.mapInArrow(score, "doc_id long, score double"), "tox-scores")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs but for the rows whose text is predicted toxic; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, plain = docs.columns.index("text"), docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(text)) < 0.5))

    with C.small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        return C.settle(plain.mapInArrow(keep, plain.schema), "tox-kept").toDF(*docs.columns)
