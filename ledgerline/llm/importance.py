"""Importance resampling towards a target distribution, with hashed n-gram features.

A text's features are its runs of 1 to N words, repeats counted; a feature's bucket is the CRC-32 of its words,
joined by one space, modulo the number of buckets. A bucket's gain is the log of the ratio of its share in the target
texts and in the documents, in thousandths, smoothed by one; a document's weight is the sum of the gains of its features.
Gumbel noise from a digest of the document's id is added, and the highest scores are drawn: a sample without
replacement in proportion to the exponent of the weights.

Features are found through a suffix array of word ids over each block of texts: suffixes are ordered by
their first N words (ids doubled in depth), the lengths of common prefixes of neighbours mark the runs of equal n-grams,
each run is hashed once, and its bucket is scattered back to all places where it stands.

The counts of buckets (a table of fixed size), the weights and the ranks are made by Spark: buckets of a document are kept
as an array, so texts are read once; ranks come from sums over ranges of the order, so no task sees all scores.

Defined results: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; null, empty or wordless texts
have no features and weight 0; documents with too few words aren't drawn (rank null); a null doc_id is
scored as "null" and comes first among equal scores; rows of equal score and id are ordered by weight, then number of
features; repeated rows are documents of their own; an empty target has T = 0; empty tables give empty results; a text of any
length is one block at least; other columns may have any names and are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids ordered by the depth ids from each on, and how many of these each shares with the place before it."""
    rank, have = ids, 1
    while have < depth:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: max(len(rank) - have, 0)] = rank[have:]
        order = np.lexsort((ahead, rank))
        new = np.ones(len(rank), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        have *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(ids), np.int64)
    same = np.ones(max(len(ids) - 1, 0), bool)
    padded = np.concatenate([ids, np.full(depth, -1, np.int64)])
    for j in range(depth):
        same &= (padded[order[1:] + j] == padded[order[:-1] + j]) & (padded[order[1:] + j] >= 0)
        shared[1:] += same
    return order, shared


def block_buckets(data: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a block of texts, row by row, where each row's begin (rows + 1 numbers), and each row's words."""
    low = data.tobytes().lower()
    starts, ends, first = C.word_bounds(data, offs, C.ALNUM)
    hashes, _ = C.word_hashes(data, offs, C.ALNUM)
    words = np.diff(first)
    rows = np.repeat(np.arange(len(words)), words)
    # Word ids with an end of its own after each row, so that no common prefix reaches into the next row.
    ids = np.empty(len(hashes) + len(words), np.int64)
    place = np.arange(len(hashes)) + rows
    ids[place] = np.unique(hashes, return_inverse=True)[1]
    last = first[1:] + np.arange(len(words))
    ids[last] = len(hashes) + np.arange(len(words))
    word_at = np.full(len(ids), -1, np.int64)
    word_at[place] = np.arange(len(hashes))
    left = np.zeros(len(ids), np.int64)
    left[place] = first[1:][rows] - np.arange(len(hashes))
    order, shared = suffix_array(ids, longest)
    found, owner = [], []
    for n in range(1, longest + 1):
        run = np.cumsum(shared < n) - 1
        heads = order[np.flatnonzero(shared < n)]
        of_run = np.zeros(len(heads), np.int64)
        for k in np.flatnonzero(left[heads] >= n):
            w = word_at[heads[k]]
            gram = low[starts[w] : ends[w]] if n == 1 else b" ".join(low[starts[w + j] : ends[w + j]] for j in range(n))
            of_run[k] = zlib.crc32(gram) % buckets
        at = np.empty(len(ids), np.int64)
        at[order] = of_run[run]
        whole = place[left[place] >= n]
        found.append(at[whole])
        owner.append(rows[word_at[whole]])
    found, owner = np.concatenate(found), np.concatenate(owner)
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(words)), out=begins[1:])
    return (found if longest == 1 else found[np.argsort(owner, kind="stable")]), begins, words


def features(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words and buckets (one a feature, repeats counted) of every row of docs (doc_id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offs in C.text_chunks(batch.column(1)):
                values, begins, words = block_buckets(data, offs, longest, buckets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(words.astype(np.int64)), C.int_list(values.astype(np.int32), begins)], ["doc_id", "n_words", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(found, "doc_id long, n_words long, buckets array<int>")


def _counts(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from two tables of features: a list of fixed length."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_counts(source, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").fillna(0)
    rows = sorted((r.bucket, r.s, r.t) for r in both.collect())
    s, t = (np.array([r[k] for r in rows], np.float64) for k in (1, 2))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); target has texts (text).

    Ranks count from 1 down the scores over the drawn percent of the documents that have enough words.
    """
    found = C.settle(features(docs, longest, buckets), "resample-features")
    wanted = C.settle(features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets), "resample-target")
    table = F.lit(gains(found, wanted, buckets))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sofar, b: sofar + F.get(table, b))
    scored = found.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = scored.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row"))
    scored = C.settle(scored, "resample-scores")
    C.discard(found, wanted)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features").desc(), F.col("row").asc()]
    ranked = C.running(able, None, order, ["one"])
    rank = F.when(F.col("before_one") < drawn, F.col("before_one") + 1)
    out = ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words)
    return out.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
