"""MinHash near-duplicates by a signature-coordinate inverted join.

Every text class (documents with one shingle set) has a signature of `coords` minima. A class is posted
under coordinate-value pairs; two classes whose shingle sets reach the threshold agree in at least
`least_matches` coordinates but for a chance below MISS. So, with each class's pairs in order of rarity,
two such classes meet in the first (shared - least_matches + 1) of them: the prefix. Pairs that only one
class holds are skipped, and long lists are only reached by classes that hold little else; a class that
shares too few pairs to reach the count is skipped whole. A list first links each class with the list's
most shared one; collisions of such a pair are counted over all coordinates, and it is retained if they reach
`least_matches`. Classes of lists that are still in different components then meet under the rarest of
their full shingle sets, with the exact prefixes of the threshold, block by block, so that groups whose
texts share much but not enough don't pair up. Every link is confirmed on the full sets, and components
follow by contracting labels until no edge is left.

Defined results: null or empty text, or text without words, is an empty set, linked with nothing; a null
doc_id is linked with nothing; fewer words than a shingle make one shingle of the whole sequence; rows
that repeat a doc_id are one document, with the links of all its texts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: The chance, for one pair exactly at the threshold, to agree in fewer coordinates than are asked for.
MISS = 1e-7
#: Classes of one posting list that are compared at a time.
BLOCK = 256
#: Sets up to this size are compared by parts of their shingles before the full sets are, larger ones by a signature of so many bytes.
SMALL, FINE = 512, 512


def least_matches(coords: int, threshold: float) -> int:
    """The largest t for which a pair at the threshold agrees in fewer than t coordinates with a chance below MISS."""
    below = 0.0
    for t in range(coords + 1):
        below += math.comb(coords, t) * threshold**t * (1 - threshold) ** (coords - t)
        if below > MISS:
            return max(t, 1)
    return coords


def _seeds(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_117)
    return rng.integers(0, 2**63, coords, dtype=np.uint64), rng.integers(0, 2**62, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _identity(sets: np.ndarray, begins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, whatever its order."""
    return tuple(C.reduced(np.add, C.mix(sets ^ np.uint64(salt)), begins, rows).view(np.int64) for salt in (0x1234567, 0x89ABCDEF01))


def signatures(docs: DataFrame, shingle: int, coords: int) -> DataFrame:
    """A row per document: doc_id, n_shingles, the set's identity (fp1, fp2), and the signature; null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, times = _seeds(coords)
        for batch in batches:
            ids = batch.column(0)
            for at, n, data, offs in C.text_chunks(batch.column(1)):
                sets, begins = C.distinct_shingles(*C.word_hashes(data, offs, C.SPACED), shingle)
                sizes = np.diff(begins)
                full = np.flatnonzero(sizes)
                sig = np.empty((len(full), coords), np.int32)
                for k in range(coords):
                    sig[:, k] = (C.reduced(np.minimum, (sets ^ flip[k]) * times[k], begins, full) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                fp = np.zeros((2, n), np.int64)
                fp[:, full] = _identity(sets, begins, full)
                empty = sizes == 0
                begins_sig = np.zeros(n + 1, np.int32)
                np.cumsum(np.where(empty, 0, coords), out=begins_sig[1:])
                lists = pa.ListArray.from_arrays(pa.array(begins_sig), pa.array(sig.ravel()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(sizes.astype(np.int64)), pa.array(fp[0], mask=empty), pa.array(fp[1], mask=empty), lists], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(nid, grams) of the classes in nodes (nid, rep), from the texts of their representatives."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for at, n, data, offs in C.text_chunks(batch.column(1)):
                sets, begins = C.distinct_shingles(*C.word_hashes(data, offs, C.SPACED), shingle)
                full = np.flatnonzero(np.diff(begins))
                fp = np.zeros(n, np.int64)
                fp[full] = _identity(sets, begins, full)[0]
                same = (fp == want[at : at + n]) & (np.diff(begins) > 0)
                out = pa.RecordBatch.from_arrays([pa.array(want[at : at + n]), C.int_list(sets.view(np.int64), begins)], ["nid", "grams"])
                yield out.filter(pa.array(same))

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.join(C.maybe_broadcast(nodes), "rep").select("nid", "text").mapInArrow(sets_of, "nid long, grams array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach num / den, as pairs of their representatives."""
    ends = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    nodes = C.settle(classes.select("nid", "rep").join(ends, "nid", "left_semi"), "dup-nodes")
    sets = C.settle(_shingle_sets(docs, nodes, shingle), "dup-sets")
    C.discard(nodes)
    left, right = (sets.select(F.col("nid").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "ab")
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    links = both.select("a", "b", shared.alias("i"), (F.size("grams_a") + F.size("grams_b") - shared).alias("u")).filter(F.col("i") * den >= F.col("u") * num)
    rep = classes.select("nid", "rep")
    links = C.settle(links.select("a", "b").distinct().join(rep.toDF("a", "u"), "a").join(rep.toDF("b", "v"), "b").select("a", "b", "u", "v"), "dup-links")
    C.discard(sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (u, v): the smallest node that is reachable. Nodes without edges aren't returned.

    Local contraction: in each round every label goes over to the first, in a random order, of itself and its
    neighbours, and the edges go over to the new labels, until none is left. A label that is last among its
    neighbours is never chosen, so each round has fewer labels; a new order every second round leaves a fixed
    share of them in expectation, so the rounds are logarithmic.
    """
    both = C.settle(edges.select("u", "v").union(edges.select("v", "u")).filter("u != v").distinct(), "cc-edges")
    labels = C.settle(both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct(), "cc-0")
    step = 0
    while not both.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(step // 2), c).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        first = both.groupBy("u").agg(F.min(order("v")).alias("near"))
        over = C.settle(first.select(F.col("u").alias("label"), F.least("near", order("u"))["to"].alias("to")), "cc-over")
        to = C.maybe_broadcast(over)
        used = [over, labels, both]
        labels = C.settle(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        both = both.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v").filter("a != b")
        both = C.settle(both.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "cc-edges")
        C.discard(*used)
        step += 1
    least = C.settle(labels.groupBy("label").agg(F.min("node").alias("component")), "cc-least")
    found = C.settle(labels.join(C.maybe_broadcast(least), "label").select("node", "component"), "cc-found")
    C.discard(labels, both, least)
    return found


def _prefixes(classes: DataFrame, coords: int, least: int) -> DataFrame:
    """(tok, nid, met): each class under the rarest of its coordinate-value pairs, as many as its prefix needs; met: how many it shares with others."""
    tokens = classes.select("nid", F.posexplode("sig").alias("k", "v")).select("nid", (F.col("k").cast("long") * (1 << 32) + F.col("v")).alias("tok"))
    shared = C.settle(tokens.groupBy("tok").agg(F.count("*").alias("freq")).filter("freq > 1"), "dup-freq")
    held = tokens.join(shared, "tok").groupBy("nid").agg(F.collect_list(F.struct("freq", "tok")).alias("toks"))
    first = held.filter(F.size("toks") >= least).select("nid", F.size("toks").alias("met"), F.slice(F.sort_array("toks"), F.lit(1), F.size("toks") - least + 1).alias("toks"))
    return first.select("nid", "met", F.explode("toks").alias("t")).select(F.col("t.tok").alias("tok"), "nid", "met")


def _retained(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of classes whose signatures collide in at least so many coordinates."""
    left, right = (classes.select(F.col("nid").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, hit: n + hit)
    return pairs.join(right, "b").join(left, "a").filter(same >= least).select("a", "b")


def _exact_posts(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, nid, n, short) of the classes' rarest shingles: a pair at the threshold meets under one that is short for its smaller class."""
    grams = sets.select("nid", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    shared = C.settle(grams.groupBy("gram").agg(F.count("*").alias("freq")).filter("freq > 1"), "dup-gram-freq")
    held = grams.join(shared, "gram").groupBy("nid", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "gram"))).alias("toks"))
    alone = F.col("n") - F.size("toks")
    probe = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9).cast("int") + 1 - alone
    index = F.col("n") - F.ceil(F.col("n") * 2 * num / (num + den) - 1e-9).cast("int") + 1 - alone
    first = held.withColumn("index", index).withColumn("toks", F.slice("toks", F.lit(1), F.greatest(probe, F.lit(0))))
    return first.select("nid", "n", "index", F.posexplode("toks").alias("at", "t")).select(F.col("t.gram").alias("gram"), "nid", "n", (F.col("at") < F.col("index")).alias("short"))


def _short_forms(sets: DataFrame) -> DataFrame:
    """(nid, form) of (nid, grams): of a small set 32 bits of each shingle, of a large one a signature of many coordinates of a byte."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, times = _seeds(FINE)
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values, begins = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
            large = np.flatnonzero(sizes > SMALL)
            fine = np.empty((len(large), FINE), np.uint8)
            for at in range(0, len(large), 64):
                part = large[at : at + 64]
                own = np.concatenate([values[begins[r] : begins[r + 1]] for r in part])
                starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                for k in range(FINE):
                    fine[at : at + len(part), k] = C.mix(np.minimum.reduceat((own ^ flip[k]) * times[k], starts)) >> np.uint64(56)
            forms = [(values[b:e] >> np.uint64(32)).astype(np.uint32).tobytes() for b, e in zip(begins, begins[1:], strict=False)]
            for at, r in enumerate(large):
                forms[r] = fine[at].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.binary())], ["nid", "form"])

    return sets.mapInArrow(shorten, "nid long, form binary")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = times[code] > 1
    of, code = of[both], np.unique(code[both], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(code.max()) + 1 if len(code) else 0, 16_384):
        own = (code >= at) & (code < at + 16_384)
        m = np.zeros((len(sets), min(16_384, int(code.max()) + 1 - at)), np.float32)
        m[of[own], code[own] - at] = 1
        out += m @ m.T
    return out


def _meetings(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components that meet in a list and whose short forms don't speak against a link."""
    jaccard = num / den
    least = least_matches(FINE, jaccard + (1 - jaccard) / 256)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(0)[row].values
                nid, label, size, short, block = (own.field(f).to_numpy(zero_copy_only=False) for f in ("nid", "label", "n", "short", "block"))
                order = np.lexsort((nid, size))
                nid, label, size, short, block = (x[order] for x in (nid, label, size, short, block))
                forms = own.field("form").take(pa.array(order)).to_pylist()
                ok = np.triu(label[:, None] != label[None, :], 1) & short[:, None] & (size[:, None] * den >= size[None, :] * num)
                if block.min() != block.max():
                    ok &= block[:, None] != block[None, :]
                if not ok.any():
                    continue
                small = int(np.searchsorted(size, SMALL, "right"))
                if small:
                    shared = _shared_counts([np.frombuffer(f, np.uint32) for f in forms[:small]])
                    ok[:small, :small] &= shared * den >= (size[:small, None] + size[None, :small] - shared) * num
                if small < len(nid):
                    fine = np.frombuffer(b"".join(forms[small:]), np.uint8).reshape(-1, FINE)
                    for i in range(len(fine)):
                        ok[small + i, small:] &= (fine == fine[i]).sum(1) >= least
                i, j = np.nonzero(ok)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nid[i], nid[j])), pa.array(np.maximum(nid[i], nid[j]))], ["a", "b"])

    return lists.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, coords: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text), linked at Jaccard >= num / den."""
    with C.small_batches(docs.sparkSession, 512):
        return _near_duplicates(docs, shingle, num, den, coords)


def _near_duplicates(docs: DataFrame, shingle: int, num: int, den: int, coords: int) -> DataFrame:
    least = least_matches(coords, num / den)
    sketch = C.settle(signatures(docs, shingle, coords), "dup-sketch")
    one = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
    classes = C.settle(one.select(F.col("fp1").alias("nid"), "fp2", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")), "dup-classes")

    posts = C.settle(_prefixes(classes, coords, least), "dup-posts")
    centre = F.min(F.struct((-F.col("met")).alias("met"), "nid"))["nid"]
    centres = C.settle(posts.groupBy("tok").agg(centre.alias("c"), F.count("*").alias("size")).filter("size > 1"), "dup-centres")
    stars = posts.join(centres, "tok").filter("c != nid").select(F.col("c").alias("a"), F.col("nid").alias("b")).distinct()
    stars = C.settle(_retained(stars, classes, least), "dup-stars")
    links = _confirmed(stars, docs, classes, shingle, num, den)
    C.discard(stars, centres)

    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("nid"), F.col("component").alias("label"))
    labelled = C.settle(posts.join(joined, "nid", "left").select("tok", "nid", F.coalesce("label", "nid").alias("label")), "dup-labelled")
    split = C.settle(labelled.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("tok"), "dup-split")
    open_nodes = C.settle(labelled.join(split, "tok", "left_semi").select("nid", "label").distinct(), "dup-open")
    open_reps = C.settle(classes.select("nid", "rep").join(open_nodes, "nid", "left_semi"), "dup-open-nodes")
    sets = C.settle(_shingle_sets(docs, open_reps, shingle).groupBy("nid").agg(F.min("grams").alias("grams")), "dup-open-sets")
    every = C.settle(_exact_posts(sets, num, den).join(open_nodes, "nid"), "dup-met")
    wide = every.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo != hi")
    wide = C.settle(wide.select("gram", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "dup-wide")
    met = C.settle(every.join(wide, "gram"), "dup-wide-met")
    forms = C.settle(_short_forms(sets.join(met.select("nid").distinct(), "nid", "left_semi")), "dup-forms")
    members = met.join(forms, "nid").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    spread = members.select("gram", "nid", "label", "n", "short", "block", "form", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = (
        spread.groupBy("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .agg(F.collect_list(F.struct("nid", "label", "n", "short", "block", "form")).alias("own"))
        .filter(F.size("own") > 1)
    )
    with C.small_batches(docs.sparkSession, 64):
        pairs = C.settle(_meetings(lists.select("own"), num, den), "dup-more")
    C.discard(posts, labelled, split, open_nodes, open_reps, sets, every, wide, met, forms)
    more = _confirmed(pairs, docs, classes, shingle, num, den)

    same_doc = sketch.filter("n_shingles > 0 and doc_id is not null").select("doc_id", F.col("fp1").alias("nid"), "fp2").join(classes.select("nid", "fp2", "rep"), ["nid", "fp2"])
    same_doc = same_doc.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u != v")
    several = same_doc.select("u", "v").union(same_doc.select("doc_id", "u")).union(same_doc.select("doc_id", "v"))
    final = components(links.select("u", "v").union(more.select("u", "v")).union(several))
    home = C.settle(classes.select("nid", "fp2", "rep").join(final, F.col("rep") == F.col("node"), "left").select("nid", "fp2", F.coalesce("component", "rep").alias("component_id")), "dup-home")
    out = sketch.select("doc_id", "n_shingles", "fp1", "fp2").join(home, (F.col("fp1") == F.col("nid")) & sketch["fp2"].eqNullSafe(home["fp2"]) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the near-copies: of each group the document with the smallest doc_id stays, and of rows that repeat a doc_id one."""
    found = C.settle(near_duplicates(docs, shingle, num, den), "dup-found")
    gone = C.settle(found.filter(~F.col("kept")).select("doc_id").distinct(), "dup-gone")
    stay = docs.join(C.maybe_broadcast(gone), "doc_id", "left_anti")
    again = C.settle(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "dup-again")
    if again.isEmpty():
        return stay
    again = C.maybe_broadcast(again)
    return stay.join(again, "doc_id", "left_anti").unionByName(stay.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
