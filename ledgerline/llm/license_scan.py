"""Licence scans by a positional rare-token index.

Templates are short licence texts and phrases with key phrases that a match must hold. Their words are
posted with their positions. Words that are too common in any prose aren't posted; every other licence
word of a document is looked up, so no place of a key phrase can be missed, whatever else the document
holds. Postings are intersected by relative position:
looked-up words that stand as the template has them vote for one start of the template in the text. A
start stays in the intersection if every posted word of the key phrase votes for it; its key phrase is then
verified: it must stand in the text, word for word, where the template has it. Only expressions of DataFrame functions are used.

Defined results: null text is empty; a text without words has no labels, score 0 and null first and last
word; every place of a base phrase counts, overlapping ones too; a null doc_id is carried; repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Phrase and label of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, key phrase, and the wider licence text around it, in which the key phrase stands once.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "bsd license"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost", "boost software license", "boost software license version 1 0"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]

#: A template's words that are too common in any prose to be looked up.
PLAIN = set("a and any are as be by for free in is it may not of or the this that to under use with you at on from sa nc nd 0 1 2 4".split())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """no: its number; label; words of the text; key: the key phrase's words and where they begin; base: whether it is a base phrase."""

    no: int
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    key_at: int
    base: bool

    @property
    def anchors(self) -> tuple[str, ...]:
        """The key phrase's words that aren't plain."""
        return tuple(dict.fromkeys(w for w in self.key if w not in PLAIN))


def templates(base: dict[str, str] = BASE, texts: list[tuple[str, str, str]] = TEXTS) -> list[Template]:
    found = [(label, phrase, phrase, True) for phrase, label in base.items()] + [(label, key, text, False) for label, key, text in texts]
    out = []
    for no, (label, key, text, is_base) in enumerate(found):
        words, of = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(words)) if words[i : i + len(of)] == of)
        out.append(Template(no, label, words, of, at, is_base))
    return out


def text_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty one may stand before or after them."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _SEPARATORS)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches for every row of docs (doc_id, text)."""
    known = templates() if known is None else known
    spark = docs.sparkSession
    anchors = sorted({w for t in known for w in t.anchors})
    vocabulary = sorted({w for t in known for w in t.words if w not in PLAIN})

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_words(F.col("text").cast("string")).alias("all"))
    front = (F.col("all")[0] == "").cast("int")
    back = ((F.size("all") > 1) & (F.element_at("all", -1) == "")).cast("int")
    words = words.withColumn("n_words", (F.size("all") - front - back).cast("long")).withColumn("front", front)
    words = words.withColumn("present", F.array_intersect("all", _strings(vocabulary)))
    # Only texts that hold a key phrase's word can match; only their words are kept.
    words = words.withColumn("words", F.when(F.arrays_overlap("present", _strings(anchors)), F.slice("all", F.col("front") + 1, F.greatest(F.col("n_words").cast("int"), F.lit(0)))))
    kept = C.settle(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "words"), "licence-words")

    held = kept.filter("words is not null")
    posts = [(w, t.no, i, t.key_at <= i < t.key_at + len(t.key)) for t in known for i, w in enumerate(t.words) if w not in PLAIN]
    posts = F.broadcast(spark.createDataFrame(posts, "word string, template int, at int, in_key boolean"))
    shape = [(t.no, t.label, t.base, t.key_at, list(t.key), len({w for w in t.words if w not in PLAIN}), len(t.anchors), sum(w not in PLAIN for w in t.key)) for t in known]
    shape = F.broadcast(spark.createDataFrame(shape, "template int, label string, base boolean, key_at int, key array<string>, rare int, need int, posted int"))
    places = held.select("row", F.posexplode("words").alias("pos", "word")).filter(F.col("word").isin(vocabulary))
    votes = places.join(posts, "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"), F.count_if("in_key").alias("key_votes"))
    met = votes.join(shape, "template").filter(F.col("key_votes") == F.col("posted")).join(held.select("row", "words"), "row")
    begin = F.col("start") + F.col("key_at")
    whole = (begin >= 0) & (begin + F.size("key") <= F.size("words"))
    verified = met.filter(whole).filter(F.slice("words", begin + 1, F.size("key")) == F.col("key"))
    # A verified key phrase is the least that a match has.
    share = F.least(F.lit(1.0), F.greatest(F.col("votes"), F.col("need")) / F.col("rare"))
    matches = verified.select("row", "label", "base", begin.cast("long").alias("begin"), F.when(F.col("base"), 1.0).otherwise(share).alias("share"))
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    base_start = F.when(F.col("base"), F.col("begin"))
    found = matches.groupBy("row").agg(
        F.count(base_start).alias("n_base"),
        F.min(base_start).alias("first_word"),
        F.max(base_start).alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    out = kept.select("row", "doc_id", "n_words").join(C.maybe_broadcast(C.settle(found, "licence-found")), "row", "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *(F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def words_of(text: str | None) -> list[str]:
    """The words of one text in plain Python, for tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
