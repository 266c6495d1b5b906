"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set (powers of two). An item's sketch is its k
smallest shingle hashes, k being one more than the most shingles that an item of its partition may lack
and still reach the threshold; so a document that contains the item holds at least one of them, and the
search misses nothing. A document's shingles are looked up in a bit table of fixed size; the hits meet
the sketches by an equi-join, and each candidate is verified by exact containment: the share of the
item's distinct shingles that the document holds.

Defined results: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; an item of
fewer words than a shingle is compared by shingles of its own length; null or empty items match
nothing, nor do null or empty documents; repeated items or documents give repeated pairs but once per
(doc_id, item_id); a null id is carried as it is; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Bits of the lookup tables, a fixed size whatever the benchmark's; more items only cost more false hits.
TABLE_BITS = 24
#: Rows that are handed to Python at a time.
TEXTS_AT_ONCE = 512


def item_shingles(items: DataFrame, shingle: int, share: float) -> DataFrame:
    """A row per item with words: item_id, width (words of a shingle), grams (distinct), sketch, and need (sketch hits that a match has at least)."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offs in C.text_chunks(batch.column(1)):
                h, first = C.word_hashes(data, offs, C.ALNUM)
                words = np.diff(first)
                for r in np.flatnonzero(words):
                    width = int(min(words[r], shingle))
                    own = np.array([0, words[r]])
                    grams = np.unique(C.shingle_hashes(h[first[r] : first[r + 1]], own, width)[0])
                    largest = (2 << int(len(grams)).bit_length() - 1) - 1
                    keep = min(len(grams), lacking(largest, share) + 1)
                    need = max(1, keep - lacking(len(grams), share))
                    yield pa.RecordBatch.from_pylist([{"item_id": batch.column(0)[at + int(r)].as_py(), "width": width, "grams": grams.view(np.int64), "sketch": grams[:keep].view(np.int64), "need": need}], _ITEM)

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(grams_of, "item_id long, width int, grams array<long>, sketch array<long>, need int")


_ITEM = pa.schema([("item_id", pa.int64()), ("width", pa.int32()), ("grams", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("need", pa.int32())])


def lacking(size: int, share: float) -> int:
    """How many of size shingles may be missing at this containment."""
    return size - int(np.ceil(share * size - 1e-9))


def _tables(items: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Bit tables of all sketch hashes and of all shingle hashes, by shingle width: at most five widths, each of a fixed size."""
    sketches, grams = {}, {}
    for row in items.select("width", "sketch", "grams").toLocalIterator():
        for table, values in ((sketches, row.sketch), (grams, row.grams)):
            bits = table.setdefault(row.width, np.zeros(1 << TABLE_BITS - 3, np.uint8))
            slot = np.array(values, np.int64).view(np.uint64) >> np.uint64(64 - TABLE_BITS)
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return sketches, grams


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - TABLE_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every pair in which docs (doc_id, text) contain items (item_id, text)."""
    found = _contained(docs.select("doc_id", "text", F.lit(None).cast("long").alias("mark")), items, shingle, share)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_shared", "n_item", "containment")))


def _contained(docs: DataFrame, items: DataFrame, shingle: int, share: float) -> DataFrame:
    """The pairs, for each row of docs (doc_id, text, mark), with its mark."""
    spark = docs.sparkSession
    with C.small_batches(spark, TEXTS_AT_ONCE):
        index = C.settle(item_shingles(items, shingle, share).withColumn("item", F.monotonically_increasing_id()), "item-index")
    sketches, grams = (spark.sparkContext.broadcast(t) for t in _tables(index))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offs in C.text_chunks(batch.column(1)):
                h, first = C.word_hashes(data, offs, C.ALNUM)
                for width, bits in sketches.value.items():
                    s, of = C.shingle_hashes(h, first, width)
                    mark = _hit(bits, s)
                    if not mark.any():
                        continue
                    rows = np.unique(of[mark])
                    inside = _hit(grams.value[width], s)
                    pick = lambda m: [np.unique(s[m & (of == r)]).view(np.int64) for r in rows]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows + at)), batch.column(2).take(pa.array(rows + at)), pa.array(np.full(len(rows), width, np.int32)), pa.array(pick(mark), pa.list_(pa.int64())), pa.array(pick(inside), pa.list_(pa.int64()))],
                        ["doc_id", "mark", "width", "hits", "held"],
                    )

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "mark").mapInArrow(look_up, "doc_id long, mark long, width int, hits array<long>, held array<long>")
    with C.small_batches(spark, TEXTS_AT_ONCE):
        found = C.settle(found.withColumn("row", F.monotonically_increasing_id()), "item-hits")
    posts = index.select("item", "width", "need", F.explode("sketch").alias("h"))
    candidates = (
        found.select("row", "width", F.explode("hits").alias("h"))
        .join(posts, ["h", "width"])
        .groupBy("row", "item")
        .agg(F.count("*").alias("met"), F.max("need").alias("need"))
        .filter("met >= need")
        .select("row", "item")
    )
    candidates = C.settle(candidates, "item-candidates")
    exact = candidates.join(found.select("row", "doc_id", "mark", "held"), "row").join(index.select("item", "item_id", "grams"), "item")
    sizes = exact.select("doc_id", "mark", "item_id", F.size(F.array_intersect("held", "grams")).cast("long").alias("n_shared"), F.size("grams").cast("long").alias("n_item"))
    return sizes.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("n_shared") >= F.ceil(F.col("n_item") * share - 1e-9))


def without_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """docs but for those that contain a test item; a document without an id is told by a hash of its text, one with an id by its id, whichever of its rows leaks."""
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    found = C.settle(_contained(docs.select("doc_id", "text", mark.alias("mark")), items, shingle, share).select(F.col("doc_id").alias("id"), F.col("mark").alias("hash")).distinct(), "leaks")
    rows = docs.select(C.packed(docs), F.col("doc_id").cast("long").alias("own"), mark.alias("mark"))
    stay = rows.join(C.maybe_broadcast_of(found.filter("id is not null").select("id"), found), F.col("own") == F.col("id"), "left_anti")
    stay = stay.join(C.maybe_broadcast_of(found.filter("id is null").select("hash"), found), F.col("mark") == F.col("hash"), "left_anti")
    return stay.select("doc.*")
