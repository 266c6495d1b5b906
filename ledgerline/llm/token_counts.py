"""Token counts through a digest cache.

A text's content is the text with every run of ASCII white space as one space, none at its ends; a null text is
empty. Its SHA-256 digest and that of the tokenizer (its file, its library and that library's version) name
a count in the cache, a Parquet table that runs share. Of the contents of a table, those whose digest the
cache lacks are encoded, each once, and their counts are appended; every document then takes its count by its
digest. Tokenizers that don't drop white space keep their texts unchanged as content.

A tokenizer that drops white space encodes the words between it one by one, so a content's count is the sum of its
words' counts; while contents are encoded, a word that a task has met before isn't encoded again.

Texts move only where they must: digests are compared with the cache first. Few misses are picked out of
the table by a broadcast of their digests; many are reduced to one text a digest, within each input split
before the shuffle, so a content that a third of all rows share is sent once a split.

Entries of a cache may be repeated (two runs at a time, a retried append): a digest always has the same count, and
a repeated one is read once. An append that failed leaves nothing that is read.

Defined results: null and empty texts have 0 bytes and 0 tokens; a text of any length is one content; repeated rows are
counted each and encoded once; ids may be null or repeated; an empty table gives an empty result and appends nothing;
other columns may have any names and are ignored.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Bytes of text that are encoded at a time; a longer text is encoded by itself.
ENCODE_BYTES = 1 << 18
#: Words that a task remembers, and the characters that such a word has at most.
REMEMBERED, SHORT = 500_000, 64
#: Words that are encoded as one text.
TOGETHER = 256
SPACE = " \t\n\x0b\x0c\r"
_ENTRY = "content binary, n_tokens long"


def _library(vocabulary: str) -> str:
    return "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"


def tokenizer_digest(vocabulary: str) -> str:
    """Hex digest of a tokenizer's version: its file, its library's name and version."""
    library = _library(vocabulary)
    with open(vocabulary, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {body}".encode()).hexdigest()


def encoder(vocabulary: str):
    """A function from texts to their numbers of tokens, without begin, end or other added tokens."""
    if _library(vocabulary) == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def word_counter(vocabulary: str):
    """A function from words to their numbers of tokens, for a tokenizer that drops white space: many words are encoded as one text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    model.no_truncation()
    model.no_padding()

    def count(words: list[str]) -> list[int]:
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        out: list[int] = []
        for group, e in zip(groups, model.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ends = np.cumsum([len(w) + 1 for w in group])
            starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            out += np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(group)).tolist()
        return out

    return count


def drops_space(vocabulary: str) -> bool:
    """Whether a tokenizer reads the words between ASCII white space apart from each other, and drops that white space.

    So it is if it looks for pieces by one pattern that can't match white space or look around itself, throws away what is between
    them, normalises by characters, and has no added token that reaches into white space.
    """
    if _library(vocabulary) == "sentencepiece":
        return False
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda name, many: [spec[name]] if spec[name] and spec[name]["type"] != "Sequence" else (spec[name] or {}).get(many, [])
    first = (parts("pre_tokenizer", "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    apart = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "(?" not in pattern and not re.search(r"\\[bBAZzG]|\^(?!\\s)|\$", pattern)
    local = all(n["type"] in ("NFC", "NFD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} for n in parts("normalizer", "normalizers"))
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(SPACE)) for t in spec["added_tokens"])
    alone = spec["post_processor"] is None
    return bool(apart and local and added and alone and not any(encoder(vocabulary)([*SPACE, SPACE])))


def content(text: Column, spaceless: bool) -> Column:
    """The normalised content of a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")) if spaceless else whole


class Words:
    """Counts of texts with single spaces between words, as sums over words that are each encoded once while they are remembered."""

    def __init__(self, count) -> None:
        self.count, self.known = count, {"": 0}

    def __call__(self, texts: list[str]) -> list[int]:
        words = [t.split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": 0}
        fresh = [w for w in set().union(*words) if w not in self.known]
        counts = dict(zip(fresh, self.count(fresh)))
        self.known |= counts
        out = [sum(map(self.known.__getitem__, ws)) for ws in words]
        for w in fresh:
            if len(w) > SHORT:
                del self.known[w]
        return out


def _encode(texts: DataFrame, vocabulary: str) -> DataFrame:
    """content and n_tokens of texts (content, text)."""
    by_words = drops_space(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Words(word_counter(vocabulary)) if by_words else encoder(vocabulary)
        for batch in batches:
            texts, counts, held, size = batch.column(1), [], [], 0
            for k in range(batch.num_rows):
                held.append(texts[k].as_py())
                size += len(held[-1])
                if size >= ENCODE_BYTES:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.mapInArrow(encoded, _ENTRY)


def _stored(spark: SparkSession, where: str) -> DataFrame:
    """The counts of a cache folder, each digest once; none if there is no such folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(where).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, cache: str) -> DataFrame:
    """doc_id, content (digest), n_bytes and n_tokens of every row of docs (doc_id, text); cache is a folder that all machines reach."""
    spark = docs.sparkSession
    where = f"{cache.rstrip('/')}/tokenizer={tokenizer_digest(vocabulary)}"
    normal = content(F.col("text"), drops_space(vocabulary))
    digest = F.unhex(F.sha2(normal, 256))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    marks = C.settle(docs.select("doc_id", digest.alias("content"), size.alias("n_bytes")), "token-marks")
    known = marks.select("content").distinct().join(_stored(spark, where), "content", "left")
    known = C.settle(known, "token-known")
    missing = C.settle(known.filter("n_tokens is null").select("content"), "token-missing")
    counts, spent = known.filter("n_tokens is not null"), [known, missing]
    if not missing.isEmpty():
        texts = docs.select(digest.alias("content"), normal.alias("text"))
        one = F.first("text").alias("text")
        if C.settled_bytes(missing) <= C.BROADCAST_BYTES:
            texts = texts.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(one)
        else:
            texts = texts.groupBy("content").agg(one).join(missing, "content", "left_semi")
        with C.small_batches(spark, 256):
            fresh = C.settle(_encode(texts.select("content", "text"), vocabulary), "token-fresh")
        fresh.write.mode("append").parquet(where)
        counts, spent = counts.unionByName(fresh), [known, missing, fresh]
    counts = C.settle(counts, "token-counts")
    C.discard(*spent)
    return marks.join(C.maybe_broadcast(counts), "content").select("doc_id", "content", "n_bytes", "n_tokens")
