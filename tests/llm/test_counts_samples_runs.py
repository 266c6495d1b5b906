"""Token counts, importance resampling and periodic runs against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("ledgerline.llm")
import public_tokenizers

from ledgerline.llm import common as C
from ledgerline.llm import importance, periodic, queries, token_counts

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, content string, n_tokens string, runs string, buckets string, score string"


def odd_rows():
    again = " ".join(["alpha", "beta", "gamma"] * 40)
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [again, again, None, "", " \t\n\x0b", "one", "a a a a a a", "A <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "J̌  x́\n\ń é", long, long, "x" * 50_000, "ß ſ K ﬁ z w", "it's  we'll\tdon't 3.14"]
    return [(i, t, "c", "n", "r", "b", "s") for i, t in enumerate(texts)] + [(None, again, None, None, None, None, None), (1, again, None, None, None, None, None), (None, None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


def brute_tokens(texts, vocabulary=WORDS):
    if vocabulary == PIECES:
        import sentencepiece

        return [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in texts])]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def entries(spark, cache):
    return spark.read.schema("content binary, n_tokens long, tokenizer string").parquet(cache).count()


@pytest.mark.parametrize("limit", [C.BROADCAST_BYTES, 0])
def test_token_counts_agree_with_the_library_and_encode_only_misses(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    encoded, cache = [], f"file://{tmp_path}/cache"
    real = token_counts._encode
    monkeypatch.setattr(token_counts, "_encode", lambda texts, vocabulary: (encoded.append(texts.count()), real(texts, vocabulary))[1])
    docs = odd(spark)
    rows = odd_rows()
    expected = Counter((r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, brute_tokens([r[1] for r in rows])))
    for _ in range(2):
        got = token_counts.token_counts(docs, WORDS, cache).select("doc_id", "n_bytes", "n_tokens").collect()
        assert Counter(map(tuple, got)) == expected
    distinct = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").strip(" ") for r in rows}
    assert encoded == [len(distinct)] and entries(spark, cache) == len(distinct)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "  one\n"), (100, "brand new"), (101, "brand\tnew")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, WORDS, cache).collect()}
    assert encoded[1:] == [1] and [got[99], got[100], got[101]] == brute_tokens(["one", "brand new", "brand new"])
    assert entries(spark, cache) == len(distinct) + 1


def test_repeated_entries_of_a_cache_count_once_and_other_tokenizers_are_misses(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = odd(spark)
    first = token_counts.token_counts(docs, WORDS, cache).collect()
    where = f"{cache}/tokenizer={token_counts.tokenizer_digest(WORDS)}"
    C.settle(spark.read.parquet(where), "again").write.mode("append").parquet(where)
    assert Counter(map(tuple, token_counts.token_counts(docs, WORDS, cache).collect())) == Counter(map(tuple, first))
    assert token_counts.tokenizer_digest(WORDS) != token_counts.tokenizer_digest(PIECES)
    rows = odd_rows()
    got = token_counts.token_counts(docs, PIECES, cache).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], n) for r, n in zip(rows, brute_tokens([r[1] for r in rows], PIECES)))


def test_a_count_is_that_of_its_content_and_the_sum_of_its_words(monkeypatch):
    rng = random.Random(3)
    parts = ["a", "B", "́", "̌", "J", "'", "s", "<|endoftext|>", "<|", "|>", "7", "é", "ß", "Σ", " ", "-", "😀"]
    spaces = [" ", "  ", "\t", "\n\n", "\x0b \x0c", "\r\n"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.7 else rng.choice(spaces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    flat = [re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ") for t in texts]
    count = token_counts.encoder(WORDS)
    assert token_counts.drops_space(WORDS) and count(texts) == count(flat)
    assert not token_counts.drops_space(public_tokenizers.path("byte_bpe_50k.json")) and not token_counts.drops_space(PIECES)
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    words = token_counts.Words(token_counts.word_counter(WORDS))
    assert [n for k in range(0, 3000, 7) for n in words(flat[k : k + 7])] == count(flat)
    assert len(words.known) < 200


def test_token_counts_of_an_empty_table_append_nothing(spark, tmp_path):
    assert token_counts.token_counts(odd(spark).limit(0), WORDS, f"file://{tmp_path}/none").count() == 0
    assert not (tmp_path / "none").exists()


def test_token_query_is_the_librarys_count_of_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    for (i, text), n in zip(docs.items(), brute_tokens(list(docs.values()))):
        assert tuple(got[i]) == (i, len((text or "").encode()), n, n > 2048)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_resampled(docs, targets, longest, buckets, percent, least, seed):
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    feats = [[bucket(g) for g in grams(alnum(t))] for _, t in docs]
    s = Counter(b for f in feats for b in f)
    t = Counter(bucket(g) for x in targets for g in grams(alnum(x)))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (i, text), f in zip(docs, feats):
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(alnum(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (3, 60, 1), (5, 100, 0)])
def test_resampling_agrees_with_brute_force(spark, longest, percent, least):
    rows = odd_rows() + [(200 + i, f"some words here {i % 7} and there {'again ' * (i % 30)}", None, None, None, None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, ODD)
    targets = ["some words here", None, "", "again again alpha beta", "alpha beta"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, doc_id int")
    got = importance.resampled(docs, target, longest, 500, percent, least).collect()
    assert Counter(map(tuple, got)) == brute_resampled([r[:2] for r in rows], targets, longest, 500, percent, least, 2024)


def test_resampling_of_empty_tables(spark):
    docs, target = odd(spark), spark.createDataFrame([], "text string")
    assert importance.resampled(docs.limit(0), target).count() == 0
    got = importance.resampled(docs, target).collect()
    assert Counter(map(tuple, got)) == brute_resampled([r[:2] for r in odd_rows()], [], 1, 10_000, 10, 20, 2024)


def test_suffix_array_orders_by_depth_and_counts_common_prefixes():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 4, 7):
        ids = rng.integers(0, 3, 80)
        order, shared = importance.suffix_array(ids, depth)
        keys = [tuple(ids[k : k + depth]) for k in order]
        assert sorted(order.tolist()) == list(range(80)) and len(set(keys)) == 1 + sum(a != b for a, b in zip(keys, keys[1:]))
        for k in range(1, 80):
            same = next((j for j in range(depth) if j >= min(len(keys[k]), len(keys[k - 1])) or keys[k][j] != keys[k - 1][j]), depth)
            assert shared[k] == same


def brute_runs(words, exponent=4, least=6):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.append((i, j - i + q, q))
            i = j + 1
    smallest = {}
    for i, length, q in found:
        smallest.setdefault((i, length), q)
    return sorted((i, length, q) for (i, length), q in smallest.items())


def collapsed(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 1), (6, 2)])
def test_runs_of_small_texts_agree_with_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
            if words and rng.random() < 0.5:
                p = rng.randint(1, len(words) // 3 + 1)
                words = [words[i % p] for i in range(len(words))] + words[:3]
            if words and rng.random() < 0.3:
                words = (words[:4] * 5 + [9]) * rng.randint(3, 6)
            texts.append(words)
        text, *parts = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), exponent, least)
        got = [[] for _ in texts]
        for t, *run in zip(text.tolist(), *(p.tolist() for p in parts)):
            got[t].append(tuple(run))
        assert got == [brute_runs(t, exponent, least) for t in texts]


def test_runs_of_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 100)
    rows = odd_rows()
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(odd(spark)).collect())
    expected = Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        runs = [(0, 60_000, 977)] if len(words) == 60_000 else brute_runs(words)
        expected[r[0], tuple(runs), collapsed(words, runs)] += 1
    assert got == expected
    assert periodic.periodic_runs(odd(spark).limit(0)).count() == 0


def test_long_texts_of_every_kind_of_repeat_are_read_in_time(spark):
    n = 40_000
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    texts = [" ".join(["x"] * n), " ".join(b[:n]), " ".join(f"p{i % 9973}" for i in range(n)), " ".join(("q" if i % 101 else f"r{i // 1010}") for i in range(n))]
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 6).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, n, 1)] and got[0].collapsed == "x"
    assert [tuple(r) for r in got[2].runs] == [(0, n, 9973)]
    assert len(got[1].runs) > 1000 and len(got[3].runs) > 300


def test_run_query_plants_its_periods_and_digests_what_the_operator_finds(spark):
    best = lambda runs: max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    planted = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words) if n < 1500 else None
        if runs is None:
            continue
        listed = "".join(f"{i},{length},{q}\n" for i, length, q in runs)
        top = (*best(runs), 1000 * best(runs)[1] // best(runs)[2]) if runs else (None,) * 4
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[doc_id]) == (doc_id, len(runs), *top, sha(listed), sha(collapsed(words, runs)))
    assert planted > 5
