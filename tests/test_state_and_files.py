"""Streams with timers, event files by splits, the hook sink, ignore files, alias chains and constructors."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import aliases as A
from ledgerline.operators import call_sites as S
from ledgerline.operators import dictionary as D
from ledgerline.operators import joins as J
from ledgerline.operators import mask as M
from ledgerline.operators import request_events as V
from ledgerline.sources import hook_sink, records, rules, trees
from ledgerline.streaming import names as N
from ledgerline.streaming import assembler, restorer, sessions
from ledgerline.streaming.replay import replayed

LATE = 10**9


def cuts(rng, rows, pieces):
    """rows, which are in order of time, in consecutive pieces of any size."""
    at = sorted(rng.randint(0, len(rows)) for _ in range(pieces - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


NAMED = "dst_ip string, flow_id string, ip string, name string, at long, ttl long"


def named_rows(rng, n):
    asked = [(rng.choice("ab"), f"f{i}", None, None, rng.randint(0, 5000), None) for i in range(n)]
    told = [(None, None, rng.choice("ab"), f"n{rng.randint(0, 9)}", rng.randint(0, 5000), rng.choice([0, 40, 900, 9999])) for _ in range(n // 2)]
    return sorted(asked + told, key=lambda r: r[4])


def named(rows, **options):
    return N.named_stream(rows.filter("flow_id is not null").select("dst_ip", "flow_id", "at"), rows.filter("flow_id is null").select("ip", "name", "at", "ttl"), **options)


def test_streamed_names_agree_with_the_batch_on_any_cut(spark):
    rng = random.Random(4)
    rows = named_rows(rng, 120)
    end = [(None, None, "end", "x", LATE, 1)]
    table = spark.createDataFrame(rows, NAMED)
    want = {r.flow_id: r.dns_names for r in J.named_at(table.filter("flow_id is not null"), table.filter("flow_id is null")).collect()}
    for pieces in (1, 3):
        parts = cuts(rng, rows, pieces)
        # Within the delay, rows may change places.
        for k in range(len(parts) - 1):
            parts[k + 1] += [parts[k].pop()] if parts[k] else []
        got = replayed([spark.createDataFrame(p, NAMED) for p in [*parts, end]], lambda r: named(r, delay="3000 seconds")).collect()
        assert {r.flow_id: r.dns_names for r in got} == want and len(got) == 120 and not any(r.names_dropped for r in got)


def test_names_beyond_the_capacity_are_told(spark):
    rows = [(None, None, "a", f"n{k}", 10 + k, 100) for k in range(4)] + [("a", "f1", None, None, 20, None), ("a", "f2", None, None, 115, None), (None, None, "a", "n9", 116, 50), ("a", "f3", None, None, 117, None), ("a", "f4", None, None, 300, None)]
    got = replayed([spark.createDataFrame(p, NAMED) for p in (rows[:3], rows[3:], [(None, None, "end", "x", LATE, 1)])], lambda r: named(r, names=2)).collect()
    assert {r.flow_id: (r.dns_names, r.names_dropped) for r in got} == {"f1": (["n0", "n1"], True), "f2": ([], False), "f3": (["n9"], False), "f4": ([], False)}


def test_streamed_session_lives_agree_with_the_batch(spark):
    rng = random.Random(6)
    uses = "session string, at_ms long, at_id long, aliases long"
    rows = sorted(((f"s{rng.randint(0, 4)}", rng.randint(0, 40_000), i, rng.choice([0, 1, 7])) for i in range(200)), key=lambda r: r[1])
    want = sorted(map(tuple, M.session_lives(spark.createDataFrame(rows, uses), 1500, 20).collect()))
    parts = [*cuts(rng, rows, 3), [("end", LATE * 1000, 0, 0)]]
    got = replayed([spark.createDataFrame(p, uses) for p in parts], lambda r: sessions.session_lives_stream(r, "5 seconds", 1500, 20)).collect()
    assert sorted(map(tuple, got)) == want


def test_a_silent_lane_is_let_go(spark):
    chunks = "lane string, seq long, now_ms long, text string, last boolean"
    first = [("a", 0, 1000, "hi PERS", False), ("b", 0, 1000, "PERSON_1 and PER", False), ("c", 0, 1000, "PER", False), ("d", 0, 0, "at PERSON_", False), ("d", 1, 1, "1", True)]
    then = [("z", 0, 5000, "on", False), ("c", 1, 1010, "SON_1", True)]
    play = lambda wait: replayed([spark.createDataFrame(p, chunks) for p in (first, then, [("z", 1, 50_000, "", True)])], lambda r: restorer.restored_stream(r, {"PERSON_1": "Ada"}, wait, "10 seconds")).collect()
    told = {}
    for r in sorted(play(False), key=lambda r: (r.lane, r.seq)):
        told[r.lane] = told.get(r.lane, "") + r.text
    assert told == {"a": "hi PERS", "b": "Ada and PER", "c": "Ada", "d": "at Ada", "z": "on"}
    assert "".join(r.text for r in play(True) if r.lane == "a") == "hi "


def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path):
    event = {"egress_event_id": "ee_1", "operation": "chat", "target": {"host_id": "hé"}}
    rng = random.Random(1)
    wrong = {}
    for name in ("a.jsonl", "b c.jsonl", "empty.jsonl"):
        lines = []
        for i in range(0 if name.startswith("empty") else 20_000):
            kind = rng.random()
            lines.append("" if kind < 0.1 else "broken\r" if kind < 0.12 else json.dumps(event | {"operation": "x" * rng.randint(1, 200)}))
        wrong[name] = [i + 1 for i, t in enumerate(lines) if t.startswith("broken")]
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = records.read_events(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20
        got = {}
        for r in rows.filter("reject is not null").collect():
            got.setdefault(r.file, []).append(r.line)
            assert r.reject == f"unparsable_record {r.file}:{r.line}"
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in wrong.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_flow_files_with_other_lines_are_read_whole(spark, tmp_path):
    flow = lambda i: {"flow_id": f"fl_{i}", "t_start_bucket": i}
    (tmp_path / "a b.jsonl").write_text(json.dumps(flow(1)) + "\nbroken\n" + json.dumps(flow(2)))
    (tmp_path / "c.json").write_text("  \n" + json.dumps([flow(3), flow(4)], indent=2))
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(flow(i)) for i in range(5, 9)))
    got = records.read_flows(spark, str(tmp_path)).filter("flow.flow_id is not null").collect()
    assert sorted((r.file, r.flow.flow_id) for r in got) == [("a b.jsonl", "fl_1"), ("a b.jsonl", "fl_2"), ("c.json", "fl_3"), ("c.json", "fl_4"), *(("d.jsonl", f"fl_{i}") for i in range(5, 9))]


def event_table(spark, n):
    made = [F.format_string("ee_%016d", F.col("id")).alias("egress_event_id"), F.lit("chat").alias("operation"), F.struct(F.lit("h").alias("host_id")).alias("target")]
    return spark.range(0, n, 1, 3).select(*made)


def told(spark, folder):
    streams = records.with_status(records.read_events(spark, folder), records.read_status(spark, folder))
    return records.collected(streams).first(), streams.count()


def test_hook_lines_come_back_with_their_status(spark, tmp_path):
    folder = f"file://{tmp_path}/hooks"
    lines = hook_sink.event_lines(event_table(spark, 300))
    for _ in range(2):
        hook_sink.write_hooks(lines, folder, 60_000, batch="one")
        total, streams = told(spark, folder)
        assert (total.events, total.dropped, total.window_ms, streams) == (300, 0, 60_000, 3)
    hook_sink.write_hooks(lines, folder, 50_000, ring=40)
    total, streams = told(spark, folder)
    assert (total.events, total.dropped, total.window_ms, streams) == (420, 180, 50_000, 6)
    kept = {r.event.egress_event_id for r in records.read_events(spark, folder).collect()}
    assert "ee_0000000000000099" in kept and len(kept) == 300
    assert not [p for p in (tmp_path / "hooks").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    bad = event_table(spark, 30).select(F.when(F.col("egress_event_id") == "ee_0000000000000029", F.raise_error(F.lit("no"))).otherwise(F.lit("{}")).alias("value"))
    with pytest.raises(Exception):
        hook_sink.write_hooks(bad, str(tmp_path / "hooks"), 1)
    assert not [p for p in (tmp_path / "hooks").glob("hook-*")]


def test_streamed_hook_lines(spark, tmp_path):
    spark.dataSource.register(hook_sink.HookSink)
    folder = str(tmp_path / "hooks")
    for n in (10, 25):
        hook_sink.event_lines(event_table(spark, n)).write.mode("append").text(str(tmp_path / "in"))
        q = spark.readStream.text(str(tmp_path / "in")).writeStream.format("hook_jsonl").option("path", folder).option("window_ms", 7).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(90) or True
    total, _ = told(spark, folder)
    assert (total.events, total.dropped, total.window_ms) == (35, 0, 7)
    # The same batch committed again replaces its own files.
    writer = hook_sink.HookStreamWriter({"path": folder})
    (tmp_path / "hooks" / ".x.jsonl").write_text("{}\n")
    (tmp_path / "hooks" / ".x.status").write_text("{}")
    before = sorted(p.name for p in (tmp_path / "hooks").iterdir() if "0000000000-" not in p.name and not p.name.startswith("."))
    writer.commit([hook_sink.Written(".x", 0)], 0)
    after = sorted(p.name for p in (tmp_path / "hooks").iterdir() if not p.name.startswith("."))
    assert after == sorted([*before, "hook-0000000000-00000.jsonl", "hook-0000000000-00000.jsonl.status.json"])


TREE = ["a.py", "b.log", "keep.log", "gen/x.py", "gen/deep/y.py", "src/gen/z.py", "src/b.log", "src/keep.log", "src/tmp/q.py", "src/tmp/keep.py", "doc/a/b/c.txt", "doc/c.txt", "lib/x1.o", "lib/x2.o", "lib/xa.o", "lib/sub/x1.o", "we ird/[1].py", "build/out/k.py", "build/in/k.py", "#h", "!n", "tail /t.py", "m/n/o.md", "m/o.md", "foo/bar/baz", "foo/baz"]
RULES = {
    "": "# comment\n\n*.log\n!keep.log\n/gen/\n\\#h\n\\!n\nlib/x[0-9].o\nbuild/*\n!build/in\n**/baz\nfoo/**/bar\nm/**/o.md\n",
    "src": "gen\n!b.log\ntmp/*\n!tmp/keep.py\n",
    "doc": "**/c.txt\n!/c.txt\n",
    "lib": "!x2.o\n",
    "we ird": "[[]1].py\n",
}


def test_ignore_files_agree_with_git(spark, tmp_path):
    rows = [(d, 1, i, t) for d, text in RULES.items() for i, t in enumerate(text.split("\n"))]
    rules = trees.ignore_rules(spark.createDataFrame(rows, "dir string, kind int, line int, text string"))
    got = sorted(r.path for r in trees.ignored_paths(spark.createDataFrame([(p,) for p in TREE], "path string"), rules).collect())
    for name in [*TREE, *(f"{d}/.gitignore".lstrip("/") for d in RULES)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(RULES[name[: -len(".gitignore")].rstrip("/")] if name.endswith(".gitignore") else "x")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    out = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(TREE), capture_output=True, text=True, check=True).stdout
    assert got == sorted(p for p in out.split("\0") if p)
    read = {r.path for r in trees.read_tree(spark, str(tmp_path)).select("path").collect()}
    assert read & set(TREE) == {p for p in TREE if p not in got and not p.startswith("build/")}


def test_the_strongest_ignore_file_decides(spark):
    rows = [("", 3, 0, "!x.py"), ("a", 1, 0, "x.py"), ("a", 2, 0, "y.py"), ("", 1, 0, "!y.py")]
    rules = trees.ignore_rules(spark.createDataFrame(rows, "dir string, kind int, line int, text string"))
    paths = spark.createDataFrame([("a/x.py",), ("a/y.py",), ("x.py",)], "path string")
    assert [r.path for r in trees.ignored_paths(paths, rules).collect()] == ["a/y.py"]
    assert trees.ignored_paths(paths, rules.limit(0)).count() == 0 == trees.ignored_paths(paths.limit(0), rules).count()


def test_chains_of_aliases(spark):
    rng = random.Random(2)
    records_, asked = [], []
    for message in range(40):
        for _ in range(rng.randint(0, 14)):
            owner, to = f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}"
            records_.append((message, owner, to, None, rng.randint(1, 9)) if rng.random() < 0.7 else (message, owner, None, f"ip{rng.randint(0, 3)}", rng.randint(1, 9)))
        asked += [(message, f"n{rng.randint(0, 9)}"), (message, None)]
    want = {}
    for message, owner, _, ip, ttl in records_:
        if not ip:
            continue
        put = lambda name, least: want.update({(message, ip, name): tuple(map(max, zip(want.get((message, ip, name), (0, 0)), (ttl, least))))})  # noqa: B023, E731
        put(owner, ttl)
        for m, name in asked:
            if m == message and name is not None and name != owner:
                best = {name: 99}
                found = 0
                for _ in range(4):
                    new = {}
                    for mm, o, to, _, t in records_:
                        if mm == message and to and o in best:
                            new[to] = max(new.get(to, 0), min(best[o], t))
                    best = new
                    found = max(found, best.get(owner, 0))
                if found:
                    put(name, min(found, ttl))
    got = A.address_names(spark.createDataFrame(records_, "message long, owner string, alias_to string, ip string, ttl long"), spark.createDataFrame(asked, "message long, name string"), hops=4).collect()
    assert {(r.message, r.ip, r.name): (r.ttl, r.least_ttl) for r in got} == want and len(got) == len(want)


def test_a_receiver_has_its_last_constructor(spark):
    calls = spark.createDataFrame([("a.py", "f", "c", 10, 1), ("a.py", "f", "c", 5, 2), ("a.py", "f", "c", 3, 3), ("a.py", "g", "c", 10, 4), ("b.py", "f", "c", 10, 5), ("a.py", "f", None, 10, 6), ("a.py", "f", "c", 30, 7)], "path string, scope string, receiver string, start int, variable int")
    writes = spark.createDataFrame([("a.py", "f", "c", 4, "u=1"), ("a.py", "f", "c", 8, "u=2"), ("a.py", "f", "c", 8, "u=0"), ("a.py", "f", "c", 10, "u=3"), ("a.py", "g", "d", 1, "u=4"), ("a.py", "f", "c", 20, None)], "path string, scope string, variable string, start int, arguments string")
    got = {r.variable: r.constructor for r in S.with_constructor(calls, writes).collect()}
    assert got == {1: "u=2", 2: "u=1", 3: None, 4: None, 5: None, 6: None, 7: None}


def brute_chain(base, tail, affixes):
    """Whether a tail is a chain of suffixes, by trying all splits."""
    agree = {"e": "eiöü", "a": "aıou", "i": "ei", "ı": "aı", "u": "ou", "ü": "öü"}
    last = lambda t: next((c for c in reversed(t) if c in "aeıioöuü"), None)

    def splits(rest, vowel, left):
        if not rest:
            return True
        if not left:
            return False
        for s in affixes.suffixes:
            first = next((c for c in s if c in "aeıioöuü"), None)
            if rest.startswith(s) and (first is None or vowel in agree.get(first, "")) and splits(rest[len(s) :], last(s) or vowel, left - 1):
                return True
        return False

    return bool(tail) and len(base) >= affixes.base_least and last(base) is not None and splits(tail, last(base), affixes.chain_most)


def brute_spans(text, entries, affixes):
    from ledgerline.operators.detect import fold

    body = fold(text or "")
    known = {}
    for value, entity in sorted(entries, key=lambda e: e[1]):
        if value and any(c.isalnum() or c == "_" for c in value):
            known.setdefault(fold(value.strip()), entity)
    word = lambda c: c.isalnum() or c == "_"
    out, at = [], 0
    for i in range(len(body)):
        own = [s for s in known if body.startswith(s, i)]
        if not own or (i and word(body[i - 1])):
            continue
        best = max(own, key=len)
        end = i + len(best)
        mark = body[end : end + 1] if body[end : end + 1] in ("'", "’", "ʼ") else ""
        tail = mark
        for c in body[end + len(mark) :]:
            if not word(c):
                break
            tail += c
        if (not tail or (mark and mark in affixes.apostrophes) or brute_chain(best, tail, affixes)) and i >= at:
            out.append((known[best], i, end))
            at = end
    return out


def test_dictionary_spans_agree_with_brute_force(spark):
    rng = random.Random(5)
    bits = ["ali", "Ali", "ALİ", "veli", "can", "ler", "lar", "den", "dan", "in", "ın", "de", "kılıç", "IRMAK", "a", "ex", "co"]
    gaps = [" ", "  ", "'", "’", ".", ", ", "-", "\n", "", "", "'"]
    text = lambda n: "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(n))
    texts = [(i, text(rng.randint(0, 40))) for i in range(300)] + [(900, None), (901, ""), (902, "Ahmetlerinden Ahmetlarından Ahmet'in ahmetx AHMET")]
    entries = [("Ali", "PERSON"), ("ali veli", "PERSON"), ("Veli Can", "ORG"), ("irmak", "LOC"), ("Irmak", "LOC"), ("-ex", "ORG"), ("ex-co.", "ORG"), ("a", "ORG"), ("kılıç", "LOC"), ("ALI", "ORG"), ("  ", "ORG"), ("...", "ORG"), ("Ahmet", "PERSON"), ("can", "PERSON"), ("can", "ORG")]
    affixes = T_AFFIXES
    want = {(i, *s) for i, t in texts for s in brute_spans(t, entries, affixes)}
    got = D.dictionary_spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(entries, "value string, entity string"), affixes).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300
    assert {(r.start, r.end) for r in got if r.id == 902} == {(0, 5), (28, 33), (44, 49)}
    bare = {(i, *s) for i, t in texts for s in brute_spans(t, entries, D.Affixes())}
    assert {tuple(r) for r in D.dictionary_spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(entries, "value string, entity string")).collect()} == bare


T_AFFIXES = D.Affixes(("ler", "lar", "in", "ın", "den", "dan", "de", "da", "ki", "leri", "inden"), "'’", 3, 3)


def test_a_million_entries_are_looked_up(spark):
    entries = spark.range(1_000_000).select(F.concat(F.lit("Firma"), F.col("id"), F.lit(" Ltd")).alias("value"), F.lit("ORG").alias("entity"))
    texts = spark.range(2000).select("id", F.concat(F.lit("to firma"), F.col("id") * 1000, F.lit(" LTD and FİRMA7 Ltd, not firma"), F.col("id") + 5_000_000, F.lit(" ltd")).alias("text"))
    got = D.dictionary_spans(texts, entries, T_AFFIXES)
    assert got.count() == 3000 and [tuple(r) for r in got.filter("id = 3").orderBy("start").collect()] == [(3, "ORG", 3, 16), (3, "ORG", 21, 31)]


def test_a_common_word_does_not_lead_to_all_entries_that_begin_with_it(spark):
    """5,000 entries begin with 'the'; a place of it meets those that its next word begins with, and of these the longest."""
    entries = spark.range(5000).select(F.concat(F.lit("the w"), F.col("id")).alias("value"), F.lit("ORG").alias("entity")).unionByName(spark.sql("select 'the' value, 'PERSON' entity"))
    texts = spark.range(40).select("id", F.concat(F.repeat(F.lit("the z "), 2000), F.lit("the w"), F.col("id") + 100, F.lit("ler")).alias("text"))
    words = spark.sql("select * from values ('the', ' ', 'z'), ('the', ' ', 'w123ler'), ('the', '', null) as t(word, gap, next)")
    one, two = D._heads(words, D.posted(entries), T_AFFIXES)
    assert [(r.word, r.spelling) for r in one.collect()] == [("the", "the")] and [(r.next, r.spelling) for r in two.collect()] == [("w123ler", "the w123")]
    got = D.dictionary_spans(texts, entries, T_AFFIXES).groupBy("id").agg(F.count_if(F.col("entity") == "PERSON").alias("one"), F.count_if(F.col("entity") == "ORG").alias("two"), F.max("end").alias("end")).collect()
    assert len(got) == 40 and all((r.one, r.two, r.end) == (2000, 1, 12_000 + 8) for r in got)


def test_no_table_sent_to_the_texts_grows_with_their_pairs_of_words(spark, monkeypatch):
    """3,000 words begin as the second word of an entry does; a pair is met by its beginning, and the same is found when nothing can be sent to the texts."""
    sizes, real = {}, D.settle

    def counted(df, label):
        out = real(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(D, "settle", counted)
    texts = [(i, " ".join(f"the w{i}x{k}" for k in range(100)) + " the wa'da, the walar THE WA the w-in (the w)ler the  w") for i in range(30)]
    entries = [("the", "PERSON"), ("the w", "ORG"), ("The Wa", "LOC"), ("(the w)", "ORG"), ("the w-in the", "ORG"), ("the w-in (the", "LOC")]
    want = {(i, *s) for i, t in texts for s in brute_spans(t, entries, T_AFFIXES)}
    tables = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(entries, "value string, entity string")
    got = D.dictionary_spans(*tables, T_AFFIXES).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert max(n for label, n in sizes.items() if label != "vocabulary") < 20
    monkeypatch.setattr(D, "maybe_broadcast", lambda df: df)
    assert {tuple(r) for r in D.dictionary_spans(*tables, T_AFFIXES).collect()} == want


def test_word_lists_and_affix_rules_from_files(spark):
    listed = 'schema_version = "1.0"\ndictionary_id = "d"\n[[entries]]\nvalue = "Ali Veli"\ntype = "PERSON"\n[[entries]]\nvalue = "Acme"\ntype = "ORG"\n'
    assert [tuple(r) for r in rules.dictionary(spark, listed).collect()] == [("Ali Veli", "PERSON"), ("Acme", "ORG")]
    for bad in (listed.replace("1.0", "2.0"), listed.replace('"d"', '""'), listed.replace("Acme", " "), listed.replace("ORG", "IBAN"), "["):
        with pytest.raises(rules.Refused):
            rules.dictionary(spark, bad)
    spelt = 'schema_version = "1.0"\nlanguage = "tr"\napostrophes = ["\'", "’"]\nmin_base_chars = 4\nmax_affix_chain = 2\nsuffixes = ["LER", "İn"]\n'
    assert rules.affixes("tr", spelt) == D.Affixes(("ler", "in"), "'’", 4, 2)
    for bad in (spelt.replace("tr", "de"), spelt.replace('["LER", "İn"]', "[]"), spelt.replace('"’"', '"xx"'), spelt.replace("[\"'\", \"’\"]", "[]")):
        with pytest.raises(rules.Refused):
            rules.affixes("tr", bad)
    one, two = {"id": "a", "x": 1}, {"x": 2, "id": "b"}
    assert rules.rule_set_hash([one, two]) == rules.rule_set_hash([{"id": "b", "x": 2}, one]) != rules.rule_set_hash([one])


def test_request_events_without_spans_and_quoting(spark):
    requests = spark.createDataFrame([(1, "s", None, ["b", "a", "b"]), (2, None, 7, None)], "request_id long, session_scope string, total long, degraded array<string>")
    requests = requests.withColumns({c: F.lit("x") for c in ("alias_style", "masking_profile", "policy_hash", "policy_version", "ruleset_hash")})
    masked = spark.createDataFrame([(1, "IBAN", "pattern", "label", False), (1, "IBAN", "pattern", "opaque", True), (1, "DATE", "ner", "invalid", False)], "request_id long, entity string, layer string, rung string, reused boolean")
    allowed = spark.createDataFrame([], "request_id long, entity string, scope string, path_no int, start int")
    got = {r.request_id: json.loads(r.json) for r in V.event_json(V.request_events(requests, masked, allowed)).collect()}
    assert got[1]["entities_masked"] == [{"confidence_bucket": "low", "count": 1, "layer": "ner", "type": "DATE"}, {"confidence_bucket": "deterministic", "count": 2, "layer": "pattern", "type": "IBAN"}]
    assert got[1]["alias_stats"]["by_type"] == {"DATE": {"count": 1, "ladder_rung": "invalid"}, "IBAN": {"count": 1, "ladder_rung": "label"}} and got[1]["degraded_reasons"] == ["a", "b"]
    assert got[2]["entities_masked"] == got[2]["entities_allowed"] == got[2]["degraded_reasons"] == [] and got[2]["alias_stats"]["by_type"] == {} and got[2]["latency_ms"]["total"] == 7 and got[2]["session_scope"] is None
    assert list(got[1]) == sorted(got[1])
    texts = ["plain", 'q"\\\n\r\t\x01\x1f\x7f é', "", "\\u0001"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.json_quote(F.col("t")).alias("q")).collect()
    assert all(json.loads(r.q) == r.t for r in rows) and {r.t: r.q for r in rows}[texts[1]] == '"q\\"\\\\\\n\\r\\t\\u0001\\u001f\x7f é"'


def streamed_plan(spark, tmp_path, rows, schema, stream):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()


def test_many_keys_are_assembled_with_their_state_at_hand(spark, tmp_path):
    schema = "key long, at long, event_id long, kind string, bytes long"
    rows = [(k, t, t, kind, 5) for k in range(400) for t, kind in enumerate(["volume", "connect", "volume", "close", "connect", "volume"])]
    drains = [(k, 99, 0, "drain", 0) for k in range(400)]
    # A state that is fetched by calls, some for each key, took most of the time.
    assert "TransformWithState" not in streamed_plan(spark, tmp_path, rows, schema, assembler.assembled_stream)
    got = replayed([spark.createDataFrame(p, schema) for p in ([r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3], drains)], assembler.assembled_stream).collect()
    assert sorted(map(tuple, got)) == sorted(t for k in range(400) for t in ((k, 0, 1, 1, 5, True, 1), (k, 1, 4, 1, 5, False, 0)))


def test_flows_and_answers_of_a_second_are_gathered_before_their_state(spark, tmp_path):
    rows = [("a", f"f{k}", None, None, 20, None) for k in range(500)] + [(None, None, "a", f"n{k % 3}", 10, 30 + k % 2) for k in range(500)] + [("a", "g", None, None, 41, None), ("a", "h", None, None, 40, None)]
    plan = streamed_plan(spark, tmp_path, rows, NAMED, named)
    assert "Aggregate" in plan and plan.index("TransformWithState") < plan.index("Aggregate")
    got = replayed([spark.createDataFrame(p, NAMED) for p in (rows, [(None, None, "end", "x", LATE, 1)])], named).collect()
    names = ["n0", "n1", "n2"]
    assert {r.flow_id: r.dns_names for r in got} == {f"f{k}": names for k in range(500)} | {"g": [], "h": names} and len(got) == 502


def test_many_sessions_wait_and_end_with_their_state_at_hand(spark, tmp_path):
    uses = "session string, at_ms long, at_id long, aliases long"
    rows = [(f"s{k}", at, k, 3) for k in range(400) for at in (9000, 0, 1000, 3000)]
    stream = lambda r: sessions.session_lives_stream(r, "5 seconds", 1500, 5)
    assert "TransformWithState" not in streamed_plan(spark, tmp_path, rows, uses, stream)
    got = replayed([spark.createDataFrame(p, uses) for p in ([r for r in rows if r[1] < 3000], [r for r in rows if r[1] >= 3000], [("end", LATE * 1000, 0, 0)])], stream).collect()
    assert sorted(map(tuple, got)) == sorted(t for k in range(400) for t in ((f"s{k}", 0, 0, 1000, 2500, 6, True), (f"s{k}", 1, 3000, 3000, 4500, 3, False), (f"s{k}", 2, 9000, 9000, 10500, 3, False)))
