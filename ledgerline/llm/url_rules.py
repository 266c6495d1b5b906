"""URL filters by association rules.

A URL becomes a set of tokens: its host's labels, its last two labels, path segments and their shape,
file suffix, query names. Tokens that stand in the same labelled pages are one item, an alternative of
each other, since no rule can tell them apart: a rule of such an item stands for the rules of each of its
tokens. Over all labelled pages FP-growth mines item combinations that go with the label 'bad', in its
parallel form: items are ordered by their pages, rarest first, and each item has a conditional base, its pages' more
frequent items with equal ones counted together, from which its combinations grow. No page, item or combination is left out
by a bound. What can't be a rule is not grown: a combination without enough bad pages, one with the
same pages as some of its items, and one that adds to items that stand in bad pages only. So nested and repeated items, as in
deep URLs, stay few combinations; items that overlap in no such way grow as many as there are with enough bad pages,
and a page with many of those takes long. Rules are kept by support,
confidence and lift, and a rule goes when one of some of its items is as sure. Kept rules are posted under
the tokens of their rarest item; a page's tokens look them up, and a rule blocks the page if the page has a
token of each of its items. Explicit host and path rules come first: the longest that fits decides.

Defined results: a null URL, or one without '://', has an empty host and path, fits no explicit rule and
is allowed; pages without a label take no part in mining; without labels of both kinds no rule is mined;
rows that repeat a page are judged each; a label is bad if the page is toxic or of low quality, nulls
count as good; other columns are ignored; a long URL is read whole, in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Verdict and rule (host, then path) of the explicit rules.
EXPLICIT = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
SUPPORT = 0.0005
CONFIDENCE = 0.6
LIFT = 2.0
#: Labelled pages that a rule covers, at least.
LEAST_PAGES = 8
#: Rows of a conditional base that are summed at a time.
AT_ONCE = 65_536

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def explicit_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest explicit rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(EXPLICIT, key=lambda r: len(r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = F.substring_index(host, ".", -2)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("number")).when(s.rlike(r"^[0-9]+\.[a-z]+$"), F.lit("number.suffix")).otherwise(F.lower(s))
    names = F.filter(F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(name), x))
    many = [
        tag("host=", labels),
        tag("site=", F.filter(F.array(last), lambda x: x.rlike(r"^[^.]+\.[^.]+$"))),
        tag("path=", F.transform(segments, shape)),
        tag("file=", F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), lambda x: x != "")),
        tag("query=", names),
    ]
    return F.array_distinct(F.concat(*many))


_RULES = "rule string, tokens array<string>, need array<array<string>>, size int, confidence double, anchor array<string>"


def _items(baskets: DataFrame, least: float) -> DataFrame:
    """(item, key, alternatives, n, n_bad): tokens of at least so many bad pages, those of the same pages together."""
    tokens = baskets.select(F.explode("tokens").alias("token"), "bad", "row")
    of_pages = [F.bit_xor(F.xxhash64(F.lit(salt), "row")).alias(f"pages{salt}") for salt in (0, 1)]
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), *of_pages).filter(F.col("n_bad") >= least)
    same = counts.groupBy("n", "n_bad", "pages0", "pages1").agg(F.sort_array(F.collect_list("token")).alias("alternatives"))
    return C.settle(same.select(F.array_join("alternatives", " | ").alias("item"), F.col("alternatives")[0].alias("key"), "alternatives", "n", "n_bad"), "url-items")


def grown(held: np.ndarray, n: np.ndarray, n_bad: np.ndarray, least: float, sure: float) -> list[tuple[tuple[int, ...], float | None, float]]:
    """The combinations that are grown from an item's conditional base: further items (columns of held), confidence, and the surest of them and their parts with the item.

    held: which further items each row has; n, n_bad: pages and bad pages of each row. Only of rules, those with no part
    with the item that is as sure, the confidence is told.
    """
    made: list[tuple[tuple[int, ...], float | None, float]] = []
    # Pages, and the confidence of the surest part, of the combinations that others may be grown from.
    alive: dict[int, tuple[float, float]] = {}

    def grow(items: tuple[int, ...], bits: int, rows: np.ndarray, later: np.ndarray) -> None:
        part = held[np.ix_(rows, later)]
        pages, bad = (sum((own[rows[at : at + AT_ONCE]] @ part[at : at + AT_ONCE] for at in range(0, len(rows), AT_ONCE)), np.zeros(len(later))) for own in (n, n_bad))
        fit = np.flatnonzero((bad >= least) & (pages < alive[bits][0]))
        # From the last one on, so that all parts of a combination come before it.
        for at in fit[::-1]:
            j = int(later[at])
            own, parts = bits | 1 << j, [alive.get(bits ^ 1 << i | 1 << j) for i in items] + [alive[bits]]
            if any(p is None or p[0] == pages[at] for p in parts):
                continue
            confidence, surest = bad[at] / pages[at], max(p[1] for p in parts)
            rule = confidence >= sure and confidence > surest
            made.append(((*items, j), float(confidence) if rule else None, float(max(confidence, surest))))
            if bad[at] < pages[at]:
                alive[own] = (pages[at], max(confidence, surest))
                grow((*items, j), own, rows[part[:, at]], later[fit[fit > at]])

    all_pages, all_bad = float(n.sum()), float(n_bad.sum())
    if all_bad >= least:
        made.append(((), all_bad / all_pages if all_bad / all_pages >= sure else None, all_bad / all_pages))
        alive[0] = (all_pages, all_bad / all_pages)
        if all_bad < all_pages:
            grow((), 0, np.arange(len(n)), np.arange(held.shape[1]))
    return made


def _grower(least: float, sure: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(base: pd.DataFrame) -> pd.DataFrame:
        rows = np.repeat(np.arange(len(base)), base["rest"].map(len))
        names, column = np.unique(np.concatenate([np.zeros(0, object), *base["rest"]]).astype(str), return_inverse=True)
        n, n_bad = (base[c].to_numpy(np.float64) for c in ("n", "n_bad"))
        often = np.bincount(column, n_bad[rows], len(names)) >= least
        place = np.cumsum(often) - 1
        held = np.zeros((len(base), int(often.sum())), bool)
        held[rows[often[column]], place[column[often[column]]]] = True
        names, key = names[often], base["key"].iloc[0]
        if len(names):  # rows that are equal by now are one
            bits, row = np.unique(np.packbits(held, axis=1), axis=0, return_inverse=True)
            held = np.unpackbits(bits, axis=1, count=len(names)).astype(bool)
            n, n_bad = (np.bincount(row.ravel(), x) for x in (n, n_bad))
        found = grown(held, n, n_bad, least, sure)
        items = pd.Series([[key, *(str(names[j]) for j in own)] for own, _, _ in found], dtype=object)
        return pd.DataFrame({"items": items, "confidence": pd.Series([c for _, c, _ in found], dtype="float64"), "surest": np.array([s for _, _, s in found], np.float64)})

    return run


def _minimal(grown_: DataFrame) -> DataFrame:
    """The rules of grown_ (items, the rarest first, confidence: of rules, surest) of which no part is as sure: items and confidence.

    Parts with the rarest item were compared when the rule was grown. Those without are parts of its items from the second, third, ... on:
    each of these ends is looked up. An end that wasn't grown holds a part that stands in bad pages only, which is as sure.
    """
    rules = grown_.filter("confidence is not null").select("items", "confidence")
    ends = rules.filter(F.size("items") > 1).select("items", "confidence", F.explode(F.transform(F.sequence(F.lit(2), F.size("items")), lambda k: F.slice("items", k, F.size("items")))).alias("end"))
    looked = ends.join(grown_.select(F.col("items").alias("end"), "surest"), "end", "left").filter(F.col("surest").isNull() | (F.col("surest") >= F.col("confidence")))
    return rules.join(looked.select("items").distinct(), "items", "left_anti")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule, tokens, need, size, confidence, anchor) by FP-growth over pages (page_id, url) labelled by labels (doc_id, quality, toxic)."""
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    marked = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad")).filter("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    labelled = marked.join(urls, "page_id")
    baskets = C.settle(labelled.select(F.monotonically_increasing_id().alias("row"), "bad", tokens_of(F.col("url")).alias("tokens")).filter(F.size("tokens") > 0), "url-baskets")
    total = baskets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    if not total.n or not total.bad or total.bad == total.n:
        return baskets.sparkSession.createDataFrame([], _RULES)
    least, sure = max(support * total.n, LEAST_PAGES), max(confidence, lift * total.bad / total.n)
    known = _items(baskets, least)
    # An item that stands in bad pages only is a rule, and none of its combinations is surer.
    # Items are named so that the rarest come first in the order of their names.
    ranked = F.format_string("%016d %s", "n", "key")
    alone = known.filter((F.col("n") == F.col("n_bad")) & (F.lit(1.0) >= sure)).select(F.array(ranked).alias("items"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("surest"))
    mixed = known.filter(F.col("n") > F.col("n_bad"))
    held = baskets.select("row", "bad", F.explode("tokens").alias("token")).join(C.maybe_broadcast_of(mixed.select(F.explode("alternatives").alias("token"), ranked.alias("ranked")), known), "token")
    chosen = held.groupBy("row", "bad").agg(F.sort_array(F.collect_set("ranked")).alias("keys"))
    chosen = chosen.groupBy("keys").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    bases = chosen.select(F.posexplode("keys").alias("at", "key"), "keys", "n", "n_bad").select("key", F.expr("slice(keys, at + 2, size(keys))").alias("rest"), "n", "n_bad")
    bases = C.settle(bases.groupBy("key", "rest").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-bases")
    several = bases.groupBy("key").applyInPandas(_grower(least, sure), "items array<string>, confidence double, surest double")
    rules = C.settle(alone.unionByName(several), "url-rules")
    kept = _minimal(rules)
    named = known.select(ranked.alias("key"), "item", "alternatives", "n")
    parts = kept.select("items", "confidence", F.explode("items").alias("key")).join(C.maybe_broadcast_of(named, known), "key")
    shown = parts.groupBy("items", "confidence").agg(F.sort_array(F.collect_list("item")).alias("tokens"), F.sort_array(F.collect_list("alternatives")).alias("need"), F.min(F.struct("n", "item", "alternatives"))["alternatives"].alias("anchor"))
    return C.settle(shown.select(F.array_join("tokens", " & ").alias("rule"), "tokens", "need", F.size("tokens").alias("size"), "confidence", "anchor"), "url-kept")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the surest mined rule that fits) for every row of pages (page_id, url).

    Rules without a column need are plain: each of their tokens, and their anchor, is an item of its own.
    """
    if "need" not in rules.columns:
        rules = rules.withColumns({"need": F.transform("tokens", lambda t: F.array(t)), "anchor": F.array("anchor")})
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = C.settle(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens")), "url-rows")
    rule, verdict = explicit_rule(F.col("host"), F.col("path"))
    posted = C.settle(rules.select("rule", "confidence", "need", F.explode("anchor").alias("token")), "url-posted")
    hits = rows.select("row", "tokens", F.explode("tokens").alias("token")).join(C.maybe_broadcast(posted), "token")
    hits = hits.filter(F.forall("need", lambda own: F.arrays_overlap(own, F.col("tokens")))).groupBy("row").agg(F.max(F.struct("confidence", "rule"))["rule"].alias("mined"))
    out = rows.join(hits, "row", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")
