"""Detection, masking, restoring, payloads, sources, call sites, assembly and streams."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import checksums as K
from ledgerline.functions import identity as I
from ledgerline.functions import payloads as P
from ledgerline.functions import targets as T
from ledgerline.operators import call_sites as S
from ledgerline.operators import detect as D
from ledgerline.operators import flows as W
from ledgerline.operators import joins as J
from ledgerline.operators import mask as M
from ledgerline.operators import report as R
from ledgerline.sources import records, rules, trees
from ledgerline.streaming import assembler, restorer

IBAN = "TR33 0006 1005 1978 6457 8413 26"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_checksums():
    assert K.iban(IBAN) and not K.iban(IBAN[:-1] + "7")
    assert K.tckn("10000000146") and not K.tckn("10000000147")
    assert K.card("4111111111111111") and not K.card("4111111111111112") and not K.card("9111111111111111")
    nine = "123456789"
    assert K.vkn(nine + K.vkn_tail(nine)) and not K.vkn(nine + str((int(K.vkn_tail(nine)) + 1) % 10))
    assert K.real_date(2024, 2, 29) and not K.real_date(2023, 2, 29) and not K.real_date(999, 1, 1)
    assert K.names_a_host("8.8.8.8", 4) and not K.names_a_host("127.0.0.1", 4) and not K.names_a_host("192.0.2.9", 4) and not K.names_a_host("01.2.3.4", 4)
    assert K.key_like("aB3dE5gH7jK9") and not K.key_like("aaaaaaaaaaaa")


def test_columns_agree_with_python(spark):
    values = [IBAN, "4111 1111 1111 1111", "x", "GB82WEST12345698765432", "1", ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", K.iban_column(F.col("v")).alias("i"), K.luhn_column(F.col("v")).alias("l")).collect()
    assert all(r.i == K.iban(r.v) and r.l == K.luhn(r.v) for r in rows)


def found(text):
    return {(e, text[a:b]) for e, a, b in M.chosen(D.scan(text))}


def test_detectors():
    assert ("IBAN", IBAN) in found(f"hesabim {IBAN} tamam")
    assert ("EMAIL", "ünal@örnek.com") in found("yaz: ünal@örnek.com.")
    assert ("URL", "db.example.com") in found("see https://db.example.com:8443/x")
    assert ("PHONE", "+90 555 123 45 67") in found("call +90 555 123 45 67 now")
    assert ("DATE", "2024-02-29") in found("on 2024-02-29") and not found("on 2023-02-29")
    assert ("API_KEY", "sk-abcDEF0123456789xyz") in found("key sk-abcDEF0123456789xyz")
    assert ("IPV6", "2001:4860:4860::8888") in found("at 2001:4860:4860::8888 ")
    assert ("CREDIT_CARD", "4111-1111-1111-1111") in found("4111-1111-1111-1111")
    assert ("TCKN", "10000000146") in found("no 10000000146")
    assert not found("call 127.0.0.1 or 4111111111111112x")


def test_a_rejected_match_is_read_in_parts():
    text = f"{IBAN} 99"
    assert ("IBAN", IBAN) in found(text)


def test_overlap_choice_agrees_with_brute_force(spark):
    rng = random.Random(3)
    groups = []
    for g in range(60):
        spans = [(rng.choice(D.ENTITIES), a := rng.randrange(30), a + rng.randrange(9), rng.choice([1, 2])) for _ in range(rng.randrange(9))]
        groups.append((g, spans))
    rows = spark.createDataFrame(groups, f"id int, spans {D.SPANS_DDL}").select("id", D.resolved(F.col("spans")).alias("kept")).collect()
    want = dict(groups)
    for r in rows:
        assert [(s.entity, s.start, s.end) for s in r.kept] == M.chosen(want[r.id])


def test_dictionary_with_suffixes():
    d = D.Dictionary([("Işıl Demir", "PERSON"), ("Acme", "ORG"), ("acme", "LOC")], suffixes=["da", "den", "in"])
    hits = [(e, a, b) for e, a, b, _ in d.scan("IŞIL DEMİR'in Acmeden acmexyz Acmedaden")]
    assert [h[0] for h in hits] == ["PERSON", "ORG", "ORG"]


def test_segments(spark):
    for text in ["a```b```c", "```x", "plain", "", "a```b```", "``````"]:
        parts = one(spark, D.segments(F.lit(text)))
        assert "".join(text[p.start : p.end] for p in parts) == text
        assert all(text[p.start : p.end].startswith("```") for p in parts if p.code)


def test_aliases_never_validate():
    s = M.Session(b"k")
    for i in range(200):
        iban, _ = s.mint("IBAN", f"TR33000610051978645784{i:04d}")
        tckn, _ = s.mint("TCKN", f"{10000000000 + i}")
        vkn, _ = s.mint("VKN", f"{1000000000 + i}")
        assert not K.iban(iban) and not K.tckn(tckn) and not K.vkn(vkn) and iban.startswith("TR")
    assert len(set(s.originals)) == len(s.originals)


def test_aliases_are_shared_by_spellings_and_labels_count():
    s = M.Session(b"k")
    a, again = s.mint("EMAIL", "A@x.com")
    assert s.mint("EMAIL", "a@X.com.") == (a, True) and not again and a.endswith(".invalid")
    assert s.mint("PERSON", "Ada Lovelace")[0] == "PERSON_1" and s.mint("PERSON", "Alan Turing")[0] == "PERSON_2" and s.mint("PERSON", "ada  lovelace")[0] == "PERSON_1"
    t = M.Session(b"k")
    t.withhold("I am PERSON_1")
    assert t.mint("PERSON", "Ada")[0] == "PERSON_2"
    assert M.Session(b"other").mint("EMAIL", "A@x.com")[0] != a


def test_many_cards_fall_back_to_opaque():
    s = M.Session(b"k")
    assert any(s.mint("CREDIT_CARD", f"{4000000000000000 + i}")[0].startswith("LGL_") for i in range(40))


def test_decisions():
    scope = rules.scope_path
    own = [M.Rule("allow", scope("messages")), M.Rule("mask", scope("messages[*].content")), M.Rule("block", scope("messages[*].content"), "API_KEY"), M.Rule("allow", scope("messages[0].content"))]
    at = scope("messages[1].content")
    assert M.decide(own, "mask", at, "EMAIL")[0] == "mask"
    assert M.decide(own, "mask", at, "API_KEY")[0] == "block"
    assert M.decide(own, "mask", scope("messages[0].content"), "API_KEY")[0] == "allow"
    assert M.decide([], "mask", at, "DATE", "allow")[0] == "allow"
    with pytest.raises(M.Blocked):
        M.mask_text(M.Session(b"k"), "sk-abcDEF0123456789xyz", [("API_KEY", 0, 22)], own, path=at)


def test_masking_and_restoring_tables(spark):
    texts = [(1, f"pay {IBAN} or write a@b.example.com"), (2, None), (3, "nothing"), (4, "8.8.8.8 and 8.8.8.8")]
    done = M.masked(spark.createDataFrame(texts, "doc_id long, text string"), b"k")
    rows = {r.session: r for r in done.collect()}
    assert "6457" not in rows[1].masked and rows[3].masked == "nothing" and rows[2].masked is None and len(rows[4].aliases) == 1
    back = M.restored(done.select("session", F.col("masked").alias("text"), "aliases")).collect()
    assert {r.session: r.restored for r in back} == dict(texts) and sum(r.leaked for r in back) == 0
    turns = spark.createDataFrame([(1, 0, "a@b.example.com"), (1, 1, "again A@b.example.com"), (2, 0, "a@b.example.com")], "session long, turn long, text string")
    by = {(r.session, r.turn): r.masked for r in M.masked_sessions(turns, b"k").collect()}
    assert by[1, 1] == "again " + by[1, 0] and by[2, 0] != by[1, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["PERSON_1", "PERSON_12", "user1@x.invalid", "PER", "SON", "_", "1", "2", "user", " "]), max_size=12), st.lists(st.integers(1, 7), min_size=1, max_size=20))
def test_any_cut_restores_alike(parts, cuts):
    originals = {"PERSON_1": "Ada", "PERSON_12": "Alan", "user1@x.invalid": "a@b.c"}
    text = "".join(parts)
    hold, out, at, k = restorer.Hold(originals), "", 0, 0
    while at < len(text):
        n = cuts[k % len(cuts)]
        out += hold.push(text[at : at + n], 0)
        at, k = at + n, k + 1
    out += hold.flush()
    assert out == M.restore_text(text, originals)[0]


def test_frames_cut_anywhere():
    body = b"".join(b'data: {"choices":[{"index":%d,"delta":{"content":"%s"}}]}\n\n' % (i % 2, t) for i, t in enumerate([b"PERS", b"x", b"ON_1!", b"PERSON_1"])) + b"data: [DONE]\n\n"
    want = restorer.restore_frames([body], {"PERSON_1": "Ada"})
    assert want == [(0, "Ada!"), (1, "xAda")]
    for n in (1, 2, 3, 7, 50):
        assert restorer.restore_frames([body[i : i + n] for i in range(0, len(body), n)], {"PERSON_1": "Ada"}) == want


def test_an_old_hold_is_let_go():
    hold = restorer.Hold({"PERSON_1": "Ada"})
    assert hold.push("PERS", 0) == "" and hold.tick(10) == "" and hold.tick(41, wait=True) == "" and hold.tick(41) == "PERS"


def test_restored_stream(spark, tmp_path):
    rows = [("a", 0, 0, "hi PER", False), ("a", 1, 5, "SON_1", True), ("b", 0, 0, "PERSON_1", True)]
    schema = "lane string, seq long, now_ms long, text string, last boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = restorer.restored_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"PERSON_1": "Ada"})
    q = stream.writeStream.format("memory").queryName("restored_t").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    got = {}
    for r in spark.sql("select * from restored_t order by lane, seq").collect():
        got[r.lane] = got.get(r.lane, "") + r.text
    assert got == {"a": "hi Ada", "b": "Ada"}


def test_frames_without_text_wait_behind_held_text(spark):
    line = restorer.Line({"PERSON_1": "Ada"})
    assert line.push(None, "ping", 0) == [(None, "ping")]
    assert line.push("a", "hi PER", 0) == [("a", "hi ")] and line.push(None, "ping 1", 1) == []
    assert line.push("b", "x", 2) == [("b", "x")] and line.push(None, "ping 2", 3) == []
    assert line.push("a", "SON_1", 4) == [("a", "Ada"), (None, "ping 1"), (None, "ping 2")]
    assert line.push("a", "PER", 5) == [] and line.push(None, "end", 6) == [] and line.flush() == [("a", "PER"), (None, "end")]
    rows = [(1, 0, 0, "a", "PER"), (1, 1, 0, None, "ping"), (1, 2, 0, "a", "SON_1"), (2, 0, 0, "a", "PER"), (2, 1, 0, None, None), (2, 2, 50, "a", "x")]
    told = restorer.ordered_frames(spark.createDataFrame(rows, "stream long, seq long, now_ms long, lane string, text string"), {"PERSON_1": "Ada"})
    got = [(r.stream, r.lane, r.text) for r in told.orderBy("stream", "place").collect()]
    assert got == [(1, "a", "Ada"), (1, None, "ping"), (2, "a", "PERx"), (2, None, "")]


def test_gates_fail_a_run_whose_rules_did_not_load(spark):
    assert rules.gate_hits(spark, [], False).count() == 0
    hits = rules.gate_hits(spark, ["a.toml: bad"], True)
    assert [(h.rule_id, h.verdict) for h in hits.collect()] == [("engine.rule-set-loaded", "FAIL"), ("engine.policy-loaded", "FAIL")]
    assert R.verdict(hits).first().verdict == "FAIL"


def kernel_rows():
    rng = random.Random(9)
    kinds = ["connect", "volume", "volume", "close"]
    return [(rng.randrange(6), t, t, rng.choice(kinds), t % 50) for t in range(300)]


def test_assembly_batch_equals_steps(spark):
    rows = kernel_rows()
    table = spark.createDataFrame(rows, "key long, at long, event_id long, kind string, bytes long")
    got = {(r.key, r.incarnation): (r.connected_at, r.volumes, r.bytes, r.closed, r.orphans) for r in W.assembled(table).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        state = assembler._FRESH
        for _, at, _, kind, size in (r for r in rows if r[0] == key):
            state, out = assembler.step(state, at, kind, size)
            if out:
                want[key, out[0]] = out[1:]
        if last := assembler.rest(state):
            want[key, last[0]] = last[1:]
    assert got == want


def test_assembly_stream(spark, tmp_path):
    schema = "key long, at long, event_id long, kind string, bytes long"
    rows = kernel_rows()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = assembler.assembled_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("assembled_t").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    got = {(r.key, r.incarnation): (r.connected_at, r.volumes, r.bytes, r.closed, r.orphans) for r in spark.sql("select * from assembled_t").collect()}
    ended = {(r[0]) for r in rows}
    batch = {(r.key, r.incarnation): (r.connected_at, r.volumes, r.bytes, r.closed, r.orphans) for r in W.assembled(spark.createDataFrame(rows, schema)).collect()}
    last = {k: max(i for kk, i in batch if kk == k) for k in ended}
    assert got == {k: v for k, v in batch.items() if k in got} and {k for k in batch if k[1] < last[k[0]]} <= set(got)


def test_names(spark):
    rows = [("server_name", "a", ["a", "b"]), ("server_name", "a", ["b"]), ("server_name", "a", []), ("encrypted", None, ["b"]), (None, None, ["d", "c"]), (None, None, [])]
    df = spark.createDataFrame(rows, "hello string, name string, names array<string>")
    got = [r.v for r in df.select(W.arbitrated(F.col("hello"), F.col("name"), F.col("names"), F.lit(True), F.lit(False)).alias("v")).collect()]
    assert [(v.resolved_host, v.resolved_host_source, v.degraded_reasons) for v in got] == [("a", "dns_and_sni", []), ("a", "sni", ["dns_sni_mismatch"]), ("a", "sni", ["encrypted_dns"]), (None, None, ["ech"]), ("c", "dns", []), (None, None, ["encrypted_dns"])]


def test_bounded_names(spark):
    rows = [(f"ip{i}", f"n{j}", 100 + i, j) for i in range(5) for j in range(4)]
    kept = W.bounded_names(spark.createDataFrame(rows, "ip string, name string, expiry long, at long"), addresses=2, names=3).collect()
    assert {r.ip for r in kept} == {"ip3", "ip4"} and {r.name for r in kept} == {"n0", "n1", "n2"}


def test_targets(spark):
    cases = {"https://u@Ex.com.:443/x": ("ex.com", None), "[::1]:80": ("::1", None), "a:b": ("a:b", None), "h:70000": ("h:70000", None), "h:81?q": ("h", 81), "": None, " . ": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.parse_target(F.col("t")).alias("x")).collect()
    assert {r.t: r.x and (r.x.host, r.x.port) for r in rows} == cases
    block = one(spark, T.target_block(F.lit("https://API.openai.com/v1/threads/thread_abc12345XYZ/runs?x=1")))
    assert (block.host_id, block.port, block.path_template, block.provider_ref) == ("api.openai.com", 443, "/v1/threads/{id}/runs", "openai")
    assert one(spark, T.target_block(F.lit("/relative"))).host_id == "unknown"


def test_identity(spark):
    assert one(spark, I.identity("x_", "t", F.lit(None).cast("string"), F.lit("a"))) != one(spark, I.identity("x_", "t", F.lit("a"), F.lit(None).cast("string")))
    assert one(spark, I.nfc(F.lit("é"))) == "é" and one(spark, I.nfc(F.lit("abc"))) == "abc"


def test_payloads(spark):
    body = {"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 1, "a@b.c": {"x": None}}
    paths, size, stopped = P.shape(body)
    assert paths == ["<dyn>.x", "messages[].content", "messages[].role", "model", "temperature"] and size == 1 + 4 + 2 + 8 + 4 and stopped is None
    assert P.shape("text") == ([], 0, 0)
    assert P.shape({"a": list(range(32))}) == (["a[]"], 256, 2)
    inner = json.dumps({"email": "a@b.c"})
    assert P.text_leaves({"args": inner}) == [("args", inner), ("args.email", "a@b.c")]
    assert P.rewrite({"args": inner, "n": 1}, lambda t, _: t.replace("a@b.c", "X")) == {"args": '{"email":"X"}', "n": 1}
    row = spark.createDataFrame([(json.dumps(body),), ("no json",)], "b string").select(P.payload_shape("b").alias("s"), P.leaves("b").alias("l")).collect()
    assert row[0].s.field_paths == paths and row[1].s.truncated_depth == 0 and len(row[0].l) == 3


def test_record_sources(spark, tmp_path):
    event = {"egress_event_id": "ee_1", "operation": "chat", "target": {"host_id": "h"}}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(event), "", "broken", json.dumps(event | {"extra": 1}), json.dumps(event)]))
    (tmp_path / "b.jsonl").write_text(json.dumps(event) + "\n")
    (tmp_path / "a.jsonl.status.json").write_text(json.dumps({"hook_status": "active", "dropped_events_count": 2, "observation_window_ms": 5, "failures": ["ok", "Not Safe"]}))
    rows = records.read_events(spark, str(tmp_path))
    assert sorted(r.reject for r in rows.filter("reject is not null").collect()) == ["unparsable_record a.jsonl:3", "unparsable_record a.jsonl:4"]
    status = records.read_status(spark, str(tmp_path))
    assert status.first().failures == ["ok"]
    streams = {r.file: (r.events, r.rejects, r.dropped, r.window_ms) for r in records.with_status(rows, status).collect()}
    assert streams == {"a.jsonl": (2, 2, 2, 5), "b.jsonl": (1, 0, None, None)}
    total = records.collected(records.with_status(rows, status)).first()
    assert (total.events, total.dropped, total.window_ms) == (3, 4, None)


def test_flow_sources(spark, tmp_path):
    flow = {"flow_id": "fl_1", "t_start_bucket": 1, "five_tuple": {"dst_ip": "1.2.3.4", "dst_port": 443}}
    (tmp_path / "a.json").write_text(json.dumps([flow, flow | {"flow_id": "fl_2"}]))
    (tmp_path / "b.json").write_text(json.dumps(flow | {"flow_id": "fl_3"}, indent=1))
    (tmp_path / "c.jsonl").write_text(json.dumps(flow) + "\n" + json.dumps(flow | {"flow_id": "fl_4"}) + "\n")
    assert sorted(r.flow.flow_id for r in records.read_flows(spark, str(tmp_path)).collect()) == ["fl_1", "fl_2", "fl_3", "fl_4"]


def test_source_trees(spark, tmp_path):
    for name, body in {"a.py": b"import os", "b.bin": b"\0\1", "c.py": b"\0", "d.go": b"\xff\xfe", "node_modules/x.js": b"1", "skip/y.py": b"2", "big.py": b"#" * (3 << 20)}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    rows = trees.classified(trees.read_tree(spark, str(tmp_path), [trees.ignore_pattern("skip/")])).collect()
    assert {r.path: r.reason for r in rows} == {"a.py": None, "b.bin": "binary", "c.py": "binary", "d.go": "io_error", "big.py": "too_large"}


def test_policies():
    s, p = rules.scan_policy("[reconciliation]\nvolume_band = {min_basis_points = 1, max_basis_points = 2}\n[limits]\nconfirmed_fail = 3")
    assert s.band == (1, 2) and p.confirmed_fail == 3
    default, own, digest = rules.mask_policy('default = {mode = "allow"}\n[[rule]]\nscope = "messages[*].content"\nmode = "mask"')
    assert default == "allow" and own[0].scope == ("messages", "[*]", "content")
    for bad in ("nonsense = 1", "x", '[[rule]]\nmode = "x"'):
        with pytest.raises(rules.Refused):
            rules.mask_policy(bad)
    with pytest.raises(rules.Refused):
        rules.mask_policy("", pinned="other")
    assert rules.rule_faults({"id": "python.openai.client", "version": "1.0.0", "match": [{"query": "q"}]}) == []


def test_call_sites(spark):
    source = "from openai import OpenAI\nimport acme.net as n, json\nclient = OpenAI(base_url='https://x.example:8443/v1')\ndef ask():\n    client.chat.completions.create()\n    client.chat.completions.create()\n    n.send('https://api.acme.example/')\n"
    files = spark.createDataFrame([("a.py", "python", source), ("b.py", "python", "def ("), ("c.go", "go", "x")], "path string, language string, source string")
    calls, imports = S.extracted(files)
    table = spark.createDataFrame([("python.openai.chat", "openai", ["OpenAI"], ["create"], "openai", "sdk", "confirmed")], "rule_id string, module string, symbols array<string>, methods array<string>, provider_ref string, egress_kind string, confidence string")
    found = S.declared_points(S.matched(calls, table)).collect()
    assert len(found) == 2 and len({r.ep_id for r in found}) == 2 and {r.symbol for r in found} == {"ask"} and {r.operation for r in found} == {"client.chat.completions.create"}
    left = S.unclaimed_imports(imports, spark.createDataFrame([("own",)], "module string"), table).collect()
    assert [(r.path, r.module) for r in left] == [("a.py", "acme.net")]


def test_names_held_at_a_time(spark):
    flows = spark.createDataFrame([("f1", "ip", 100), ("f2", "ip", 131), ("f3", "other", 100)], "flow_id string, dst_ip string, at long")
    answers = spark.createDataFrame([("ip", "a", 100, 5), ("ip", "b", 90, 99999)], "ip string, name string, at long, ttl long")
    assert {r.flow_id: r.dns_names for r in J.named_at(flows, answers).collect()} == {"f1": ["a", "b"], "f2": ["b"], "f3": []}


def test_import_without_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ledgerline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'q15_dormant' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=False).returncode == 0


def test_column_checks_agree_with_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        nine = str(rng.randrange(10**8, 10**9))
        rows.append((nine + (K.tckn_tail(nine) if rng.random() < 0.5 else "11"), nine + (K.vkn_tail(nine) if rng.random() < 0.5 else "0"), str(rng.choice([4, 34, 2720, 36, 9792])) + "".join(str(rng.randrange(10)) for _ in range(rng.choice([10, 12, 13]))), rng.randrange(990, 2100), rng.randrange(14), rng.randrange(33)))
    rows += [("", "", "", 0, 0, 0), ("1234567890x", "12345678 0", "4x", 2000, 2, 29)]
    table = spark.createDataFrame(rows, "t string, v string, c string, y int, m int, d int")
    got = table.select("*", K.tckn_column(F.col("t")).alias("t1"), K.vkn_column(F.col("v")).alias("v1"), K.card_column(F.col("c")).alias("c1"), K.real_date_column(F.col("y"), F.col("m"), F.col("d")).alias("d1")).collect()
    for r in got:
        assert (r.t1, r.v1, r.c1, r.d1) == (K.tckn(r.t), K.vkn(r.v), K.card(r.c), K.real_date(r.y, r.m, r.d)), r


def test_dictionary_and_code_reach_detection(spark):
    known = D.Dictionary([("Ada Lovelace", "PERSON")])
    text = "Ada Lovelace, a@b.example ```Ada Lovelace c@d.example``` end"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no value")], "doc_id long, text string")
    kinds = lambda code: [(s.entity, s.start) for s in D.detected(rows, "text", known, code).filter("doc_id = 1").first().spans]
    inner, mail = text.index("Ada", 5), text.index("c@d")
    assert kinds("pattern") == [("PERSON", 0), ("EMAIL", 14), ("EMAIL", mail)]
    assert kinds("full") == [("PERSON", 0), ("EMAIL", 14), ("PERSON", inner), ("EMAIL", mail)]
    assert kinds("skip") == [("PERSON", 0), ("EMAIL", 14)]
    done = M.masked(rows, b"k" * 32, dictionary=known).filter("session = 1").first()
    assert "PERSON_1" in done.masked and "Ada Lovelace" in done.masked and "a@b.example" not in done.masked
    with pytest.raises(ValueError):
        D.detected(rows, "text", known, "none")


def test_dates_are_refused_or_pass_by_policy(spark):
    session, spans = M.Session(b"k" * 32), [("DATE", 0, 10)]
    assert M.mask_text(session, "2024-01-02", spans)[0] == "2024-01-02"
    for rules, policy in (([M.Rule("mask", (), "DATE")], "allow"), ([], "block")):
        with pytest.raises(M.Blocked):
            M.mask_text(session, "2024-01-02", spans, rules, date_policy=policy)
    rows = spark.createDataFrame([(1, "on 2024-01-02 a@b.example"), (2, "a@b.example")], "doc_id long, text string")
    got = {r.session: (r.masked, r.counts) for r in M.masked(rows, b"k" * 32, date_policy="block").collect()}
    assert got[1] == (None, {"refused:DATE": 1}) and got[2][0].endswith(".invalid")
    assert M.masked(rows, b"k" * 32, rules=[M.Rule("allow", (), "EMAIL")]).filter("session = 2").first().masked == "a@b.example"


def agrees_with_sql(spark, folder, name, texts):
    """What a query and its SQL return for documents of these texts: the same rows, which are given back."""
    import duckdb

    import __spark_entry__

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, str(folder)).collect()))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert got == sorted(base.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    return got


def test_addresses_beside_others_and_at_sentence_ends_are_those_of_the_sql(spark, tmp_path):
    texts = ["8.8.8.8", "at 8.8.8.8.", "1.2.3.4.5", "8.8.8.8 9.9.9.9 1.1.1.1", "8.8.8.8, 9.9.9.9", "999.1.1.1 8.8.8.8", "v8.8.8.8", "e\u0301" + "8.8.8.8\u0301", "8.8.8.8\n", "8.8.8.8\r\n9.9.9.9", "01.2.3.4", "127.0.0.1;0.0.0.0;192.0.2.7;198.51.100.7;203.0.113.9;192.0.3.7", "_8.8.8.8", "\u0663" + "8.8.8.8", "256.1.1.1", "1.2.3.4444", None, ""]
    got = agrees_with_sql(spark, tmp_path, "q42_ipv4_values", texts)
    assert (0, "8.8.8.8") in got and not any(i in (1, 2, 6) for i, _ in got)
    shown = [c for c in ("8.8.8.8", "127.0.0.1", "192.0.2.9", "01.2.3.4", "0.0.0.0", "0.0.0.1", "256.1.1.1", "10.0.0.0", "203.0.113.0")]
    rows = spark.createDataFrame([(c,) for c in shown], "a string").select("a", K.names_a_host_column(F.col("a")).alias("ok")).collect()
    assert all(r.ok == K.names_a_host(r.a, 4) for r in rows)


def test_texts_without_shapes_are_not_sent_to_python(spark):
    rows = spark.createDataFrame([(1, "mail a.b@c.example now"), (2, "plain words"), (3, None), (4, "")], "id long, text string").select("id", D.candidates(F.col("text")).alias("spans"))
    [handed] = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython" in line]
    assert "_scan_series(CASE WHEN" in handed and "RLIKE" in handed
    assert {r.id: [(s.entity, s.start, s.end) for s in r.spans] for r in rows.collect()} == {1: [("EMAIL", 5, 18)], 2: [], 3: [], 4: []}
