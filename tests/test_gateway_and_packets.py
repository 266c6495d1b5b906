"""Requests as rows, and packet readings."""

import json
import struct

from pyspark.sql import functions as F

from ledgerline.operators import gateway as G
from ledgerline.sources import packets as P


def test_routes(spark):
    cases = [
        ("POST", "/v1/chat/completions", "masked_round_trip"), ("GET", "/v1/chat/completions", "method_not_allowed"), ("POST", "/v1/embeddings", "masked_one_way"), ("GET", "/v1/models", "no_user_text"),
        ("POST", "/v1/messages", "not_found"), ("POST", "/v1/audio/transcriptions", "endpoint_unsupported"), ("POST", "/v1/audiox", "not_found"), ("POST", "/v1/threads/t1", "unmasked_and_declared"),
        ("GET", "/admin/metrics", "own"), ("POST", "/admin/metrics", "method_not_allowed"), ("GET", "/admin/other", "not_found"), ("GET", "/_ledgerline/session/abc", "own"), ("GET", "/_ledgerline/session/", "not_found"), ("GET", "/x", "not_found"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "m string, p string").select("m", "p", G.treatment(F.col("m"), F.col("p")).alias("t")).collect()
    assert [(r.m, r.p, r.t) for r in rows] == cases


def test_upstream(spark):
    cases = {"https://API.example.com/v1": None, "http://api.example.com": "plaintext", "http://127.0.0.1:80": None, "https://u@api.example.com": "user_in_authority", "https://evil.test": "host_not_allowed", "api.example.com": "not_absolute", "https://api.example.com/../x": "way_up", "https://api.example.com?x": "not_a_base"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", G.upstream_fault(F.col("u"), ["api.example.com", "127.0.0.1"]).alias("f")).collect()
    assert {r.u: r.f for r in rows} == cases


def test_headers_and_lines(spark):
    row = spark.createDataFrame([({"Host": "h", "X-Ledgerline-A": "1", "Authorization": "s", "Accept": "j"},)], "h map<string,string>").select(G.forwarded_headers(F.col("h")).alias("f"), G.told_headers(F.col("h")).alias("t"), G.log_line({"a": F.lit(1), "b": F.lit(None), "c": F.lit("x")}).alias("l")).first()
    assert set(row.f) == {"Authorization", "Accept"} and "Authorization" not in row.t and row.l == "a=1 c=x"


def test_tool_arguments(spark):
    cases = [({"messages": [{"role": "user", "content": "x"}]}, False), ({"tools": [1]}, True), ({"tools": None}, False), ({"messages": [{"tool_calls": [1]}]}, True), ({"messages": [{"content": [{"type": "tool_use"}]}]}, True), ({"messages": [{"content": [{"type": "text"}]}]}, False)]
    rows = spark.createDataFrame([(json.dumps(b),) for b, _ in cases] + [("no json",)], "b string").select(G.has_tool_arguments(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [t for _, t in cases] + [False]


def test_statistics(spark):
    spans = spark.createDataFrame([(1, "EMAIL", "reserved", False), (1, "EMAIL", "opaque", False), (1, "EMAIL", "reserved", True)], "request_id int, entity string, rung string, reused boolean")
    assert [(r.n, r.rung) for r in G.alias_stats(spans).collect()] == [(2, "opaque")]
    allowed = spark.createDataFrame([(1, "EMAIL", "a", 0, 5), (1, "EMAIL", "b", 0, 9)], "request_id int, entity string, scope string, path_no int, start int")
    assert G.allowed_stats(allowed).first().scope == "b"
    ring = spark.createDataFrame([(i, i) for i in range(10)], "ts long, id long")
    assert [(r.id, r.evicted) for r in G.newest(ring, 3).orderBy("id").collect()] == [(7, 7), (8, 7), (9, 7)]
    values = spark.createDataFrame([("s", "PERSON", "b", 1), ("s", "PERSON", "a", 2), ("s", "PERSON", "b", 3)], "session string, entity string, value string, at long")
    assert {r.value: r.label for r in G.label_numbers(values).collect()} == {"b": "PERSON_1", "a": "PERSON_2"}
    requests = spark.createDataFrame([("s", "openai", "unmasked_and_declared", False), ("s", "openai", "unmasked_and_declared", False), ("s", "openai", "masked_round_trip", True), ("s", "openai", "masked_round_trip", False)], "scope string, provider_ref string, treatment string, tool_arguments boolean")
    assert sorted((r.rule_id, r.requests) for r in G.declared_passthrough(requests).collect()) == [("endpoint_unsupported_passthrough", 2), ("tool_arguments_passthrough", 1)]
    assert spark.range(1).select(G.status(F.lit("alias_limit_exceeded")).alias("s")).first().s == 429


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".")) + b"\0"


def record(owner, kind, ttl, data):
    return owner + struct.pack(">HHIH", kind, 1, ttl, len(data)) + data


def response():
    question = name("www.Example.com") + struct.pack(">HH", 1, 1)
    head = struct.pack(">HHHHHH", 7, 0x8180, 1, 3, 0, 0)
    pointer = b"\xc0\x0c"
    return head + question + record(pointer, 5, 60, name("cdn.test")) + record(name("cdn.test"), 1, 30, bytes([9, 9, 9, 9])) + record(name("cdn.test"), 1, 90, bytes([9, 9, 9, 9]))


def test_answers(spark):
    assert P.dns_answers(response()) == [("9.9.9.9", "cdn.test", 90), ("9.9.9.9", "www.example.com", 90)]
    rows = spark.createDataFrame([(bytearray(response()),), (bytearray(response()[:40]),), (bytearray(b""),), (None,)], "p binary").select(P.answers("p").alias("a")).collect()
    assert len(rows[0].a) == 2 and [r.a for r in rows[1:]] == [None, None, None]
    loop = struct.pack(">HHHHHH", 7, 0x8180, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1"
    try:
        P.dns_answers(loop)
        raise AssertionError
    except P.Malformed:
        pass


def hello(extensions):
    body = b"\3\3" + bytes(32) + b"\0" + b"\0\2\x13\1" + b"\1\0" + (struct.pack(">H", len(extensions)) + extensions if extensions is not None else b"")
    message = b"\1" + len(body).to_bytes(3, "big") + body
    return b"\x16\3\1" + struct.pack(">H", len(message)) + message


def test_hellos(spark):
    entry = b"\0" + struct.pack(">H", 9) + b"A.example"
    server = struct.pack(">HHH", 0, len(entry) + 2, len(entry)) + entry
    hidden = struct.pack(">HH", 0xFE0D, 1) + b"x"
    assert P.client_hello(hello(server)) == ("server_name", "a.example")
    assert P.client_hello(hello(server + hidden)) == ("encrypted", None)
    assert P.client_hello(hello(None)) == ("none", None) and P.client_hello(hello(b"")) == ("none", None)
    assert P.client_hello(hello(server)[:60]) == ("truncated", None) and P.client_hello(b"\x17\3\3") == ("other", None)
    rows = spark.createDataFrame([(bytearray(hello(server)),), (None,)], "p binary").select(P.hellos("p").alias("h")).collect()
    assert rows[0].h.server_name == "a.example"


def kernel(kind, tail, flags=2, version=1, size=None):
    body = struct.pack("<Q", 9) + bytes([10, 0, 0, 1]).ljust(16, b"\0") + bytes([9, 9, 9, 9]).ljust(16, b"\0") + struct.pack("<HH", 5000, 443) + tail
    return struct.pack("<BBBBHH", kind, 6, flags, version, len(body) if size is None else size, 0) + body


def test_kernel_frames(spark):
    frames = [kernel(1, struct.pack("<QQIIQ", 60, 61, 7, 0, 5) + b"python".ljust(16, b"\0")), kernel(2, struct.pack("<QQQ", 1, 2, 3)), kernel(3, struct.pack("<Q", 40), flags=16), kernel(2, b"", version=2), kernel(2, b"x", size=3), kernel(9, b""), kernel(3, b"123"), b"12"]
    rows = spark.createDataFrame([(bytearray(f),) for f in frames], "f binary").select(P.kernel_frames("f").alias("k")).select("k.*").collect()
    assert [r.fault for r in rows] == [None, None, None, "unsupported_version", "length_mismatch", "unknown_kind", "truncated", "truncated"]
    assert (rows[0].comm, rows[0].pid, rows[0].pid_start_time, rows[0].netns, rows[0].dst_ip, rows[0].dst_port) == ("python", 7, None, 9, "9.9.9.9", 443)
    assert (rows[1].bytes_out, rows[1].segments_out, rows[2].duration_ms) == (1, 3, 40)
