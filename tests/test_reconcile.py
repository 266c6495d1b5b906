"""Reconciliation: golden cases, and every registered query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import derive as D
from ledgerline.operators import episodes as E
from ledgerline.operators import joins as J
from ledgerline.operators import report as R
from ledgerline.operators import validate as V
from ledgerline.plans import evidence, measures, relational, textual

SF = "/root/testdata/sf0.001"
POINT = "ep_id string, operation string, host string, port int, provider_ref string, path string"
EVENT = "egress_event_id string, module string, operation string, host_id string, port int, path_template string, provider_ref string, byte_size_estimate long, target_unresolved boolean, field_path string, call_site_path string, row_no long"
FLOW = "flow_id string, t_start_bucket long, duration_ms long, resolved_host string, dst_ip string, dst_port int, pid long, pid_start_time long, comm string, flow_scope string, process_attribution string, provider_ref string, classification string, bytes_out long"


def points(spark, *rows):
    return spark.createDataFrame([(f"ep_{i}", r[0], r[1], r[2], r[3], "src/a.py") for i, r in enumerate(rows)], POINT)


def events(spark, *rows):
    made = [(f"ee_{i}", "m", r[0], r[1], r[2], "/v1", r[3], r[4] if len(r) > 4 else 100, False, "a", "b", i) for i, r in enumerate(rows)]
    return J.observed_events(spark.createDataFrame(made, EVENT))


def flow(i, start=1000, ms=0, host="h.example", port=443, bytes_out=2048, scope="in_scope", pid=1, provider="px", flow_id=None):
    return (flow_id or f"fl_{i}", start, ms, host, "10.0.0.1", port, pid, 5, "python", scope, "kernel_attributed", provider, "classified", bytes_out)


def flows(spark, *rows):
    return spark.createDataFrame(list(rows), FLOW)


def test_dormant_points(spark):
    p = points(spark, ("op.a", "a.example", None, "p1"))
    assert D.dormant(p, events(spark, ("op.b", "b.example", None, "p2")), D.Settings()).first().confidence == "suspect"
    assert D.dormant(p, events(spark), D.Settings()).first().confidence == "confirmed"
    assert D.dormant(p, events(spark, ("op.a", "b.example", None, "p2")), D.Settings()).count() == 0
    provider_only = D.dormant(p, events(spark, ("op.b", "b.example", None, "p1")), D.Settings()).first()
    assert provider_only.confidence == "suspect" and provider_only.evidence.startswith("J2:provider_only ")


def test_drift(spark):
    p = points(spark, ("op.a", "a.example", None, "p1"), (None, "a.example", None, "p1"))
    found = D.drift(p, events(spark, ("op.a", "x.a.example", None, "p9"), ("op.a", "x.a.example", None, "p9"), ("op.a", "a.example", 8443, "p9"), ("op.a", "10.1.2.3", None, "p9"))).collect()
    assert [f.primary_ref for f in found] == ["ep_0"]
    assert sorted(d.split("drift=")[1] for d in found[0].evidence.split("; ")) == ["address_literal", "port", "subdomain"]


def test_unmatched_traffic(spark):
    p, e = points(spark, ("op.a", "a.example", None, "p1")), events(spark, ("op.a", "a.example", None, "p1"))
    f = flows(spark, flow(1))
    assert D.unmatched(p, e, f, D.Settings()).first().confidence == "confirmed"
    unreadable = events(spark, ("op.a", "a.example", None, "p1"), ("op.a", "unknown", None, "p1"))
    assert D.unmatched(p, unreadable, f, D.Settings()).first().confidence == "suspect"
    assert D.unmatched(p, e, flows(spark, flow(1, scope="out_of_scope_process")), D.Settings()).count() == 0
    assert D.unmatched(p, e, flows(spark, flow(1, provider="p1")), D.Settings()).count() == 0
    assert D.unmatched(p, None, f, D.Settings()).first().confidence == "suspect"


def test_volume(spark):
    f = flows(spark, flow(1, host="a.example", bytes_out=2048))
    assert D.volume(events(spark, ("op.a", "a.example", None, "p1", 512)), f, D.Settings()).first().confidence == "confirmed"
    assert D.volume(events(spark, ("op.a", "a.example", None, "p1", 1024)), f, D.Settings()).count() == 0
    assert D.volume(events(spark, ("op.a", "a.example", None, "p1", 0)), f, D.Settings()).count() == 0
    two = D.volume(events(spark, ("op.a", "a.example", None, "p1", 10), ("op.b", "a.example", None, "p1", 10)), f, D.Settings()).first()
    assert two.confidence == "suspect" and "band_bytes=10..60" in two.evidence


def test_shared_flow_id_shares_its_calls(spark):
    f = flows(spark, flow(1, host="a.example", bytes_out=100, flow_id="fl_x"), flow(2, host="b.example", bytes_out=100, flow_id="fl_x"))
    found = D.volume(events(spark, ("op", "a.example", None, "p", 10), ("op", "b.example", None, "p", 20)), f, D.Settings())
    assert found.count() == 2 and all("expected_bytes=30" in r.evidence for r in found.collect())


def test_episodes(spark):
    close = flows(spark, flow(1, 1000, 500), flow(2, 1001, 0), flow(3, 1002, 0))
    assert [r.flows for r in E.episodes(close).collect()] == [3]
    apart = flows(spark, flow(1, 1000), flow(2, 1002), flow(3, 1004))
    assert E.episodes(apart).count() == 3
    inside = flows(spark, flow(1, 1000, 60_000), flow(2, 1010, 0), flow(3, 1061, 0))
    assert [r.flows for r in E.episodes(inside).collect()] == [3]
    again = flows(spark, flow(1, bytes_out=100, flow_id="fl_s"), flow(2, bytes_out=300, flow_id="fl_s"))
    assert [(r.flows, r.bytes_out) for r in E.episodes(again).collect()] == [(1, 300)]
    two = flows(spark, flow(1, bytes_out=100), flow(2, bytes_out=300))
    assert [(r.flows, r.bytes_out) for r in E.episodes(two).collect()] == [(2, 400)]
    unknown = flows(spark, flow(1, bytes_out=None), flow(2, bytes_out=None))
    assert E.episodes(unknown).first().bytes_out is None


def test_input_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [flow(i, 1000 + rng.randrange(40), rng.randrange(3) * 700, bytes_out=rng.choice([None, i]), provider=rng.choice("abc")) for i in range(60)]
    one = E.episodes(flows(spark, *rows)).collect()
    rng.shuffle(rows)
    assert sorted(map(str, one)) == sorted(map(str, E.episodes(flows(spark, *rows).repartition(3)).collect()))


def test_suppression():
    s = D.Settings()
    assert D.suppressed(True, True, True, True, s) == []
    assert {r for _, r in D.suppressed(False, False, False, None, s)} == {"declared_source_absent", "runtime_source_absent", "wire_source_absent"}
    assert D.suppressed(True, True, True, True, D.Settings(window_ms=60_000)) == [("dormant_egress_point", "observation_window_too_short")]
    assert D.suppressed(True, True, True, False, s) == [("volume_anomaly", "volume_not_measured")]
    with pytest.raises(ValueError):
        D.Settings(band=(2, 1))


def test_absent_sources_are_not_planned(spark):
    p = points(spark, ("op.a", "a.example", None, "p1"))
    found, stopped = D.findings(p, None, None)
    assert found is None and len(stopped) == 5


def test_event_faults(spark):
    rows = relational.views.events(spark, SF)
    reasons = {r.fault for r in V.checked_events(rows).select("fault").distinct().collect()}
    assert reasons == {None, "malformed_event_id", "malformed_operation", "malformed_provider_ref", "raw_content_in_field_path", "absolute_call_site_path", "event_id_mismatch"}


def test_flow_faults(spark):
    schema = "flow_id string, provider_ref string, sni string, sni_source string, classification string, resolved_host string, resolved_host_source string, process_attribution string, process struct<exe:string>, ruleset_version string, provider_confidence string"
    good = ("fl_0123456789abcdef", "openai", "a", "client_hello", "classified", "a", "sni", "inferred", ("python3",), None, None)
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(schema.replace("struct<exe:string>", "s").split(", "), good))
    rows = [good, change(flow_id="fl_1"), change(provider_ref="Open AI"), change(sni_source="absent"), change(classification="opaque"), change(ruleset_version="1.2"), change(process=None), change(resolved_host_source="none"), change(process=("/bin/x",))]
    df = spark.createDataFrame(rows, schema)
    assert [r.f for r in df.select(V.flow_fault(df).alias("f")).collect()] == [None, "malformed_flow_id", "malformed_provider_ref", "sni_without_client_hello", "classification_without_its_witness", "malformed_ruleset_version", "attribution_disagrees_with_process", "resolved_host_source_disagrees", "path_in_record_body"]


def test_report(spark):
    found = relational._findings(spark, SF)
    report = R.build(found, None, relational.POLICY, [("volume_anomaly", "volume_not_measured")])
    assert report["verdict"] == "FAIL" and R.canonical(report).endswith("}\n")
    assert R.body_hash(report | {"envelope": 1}) == R.body_hash(report)
    assert R.summary(report).startswith("verdict FAIL")
    files = spark.createDataFrame([("a", "parsed", None), ("b", "unread", "binary"), ("c", "unread", "io_error"), ("d", "partial", None)], "path string, state string, reason string")
    assert R.coverage(files).first().unparsed_ratio_bp == 3334
    assert R.verdict(R.rule_hits(found.limit(0), 0, R.Policy())).first()[0] == "PASS"
    assert R.scan_id(found).first().scan_id == R.scan_id(found.repartition(5)).first().scan_id


def test_no_nested_loop_joins(spark):
    plan = relational.q07_j2_links(spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(_norm, v))
    return v


@pytest.mark.parametrize("name", sorted(relational.ORACLE | textual.ORACLE | measures.ORACLE | evidence.ORACLE))
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = (relational.QUERIES | textual.QUERIES | measures.QUERIES | evidence.QUERIES)[name](spark, SF)
    want = db.sql((relational.ORACLE | textual.ORACLE | measures.ORACLE | evidence.ORACLE)[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda rows, at: sorted(repr(tuple(_norm(r[i]) for i in at)) for r in rows)
    assert key([tuple(r) for r in df.select(*columns).collect()], range(len(columns))) == key(want.fetchall(), [want.columns.index(c) for c in columns])


def test_dns_names_are_those_of_all_answers(spark):
    answers = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect():
        since = e.event_id * 31 % 20000
        answers.setdefault(e.event_id % 50, []).append((since, since + min(max(e.event_id % 5 * 1000, 30), 3600), f"n{e.user_id % 40}"))
    flows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    at = lambda key: key * 7919 % 20000
    want = {f.o_orderkey: ",".join(sorted({n for since, until, n in answers.get(f.o_custkey % 50, []) if since <= at(f.o_orderkey) < until})) for f in flows}
    assert {r.flow_id: r.names for r in relational.q34_dns_names(spark, SF).collect()} == want


def test_sensor_reports(spark):
    f = flows(spark, flow(1), flow(2), flow(3, scope="known_benign"))
    bad = spark.createDataFrame([("malformed_flow_id",)], "reason string")
    status = R.sensor_status(f, bad, 4, False)
    assert status["flows"] == {"in_scope": 2, "out_of_scope_process": 0, "known_benign": 1, "undetermined": 0} and status["rejected"] == {"malformed_flow_id": 1} and status["not_measured"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(R.mode(a, b),) for a in (True, False) for b in (True, False)], "m string").select("m", R.sensor_state(F.col("m")).alias("s"), R.sources_present(F.col("m")).alias("p")).collect()
    assert {r.m: (r.s, len(r.p)) for r in rows} == {"full": ("running", 3), "static_runtime": ("not_running", 2), "static_wire": ("running", 2), "static_only": ("not_running", 1)}


def test_read_side(spark):
    from pyspark.sql import functions as F

    found = relational._findings(spark, SF)
    assert R.detail(found, found.first().finding_id).count() == 1 and R.condensed(found).count() == found.count()
    assert R.disagreements(found.filter("confidence = 'confirmed'"), found.filter("confidence = 'suspect'")).first().disagreements == 0
    assert R.unmatched_count(found).first().unmatched == found.filter("kind = 'unmatched_wire_traffic'").count()
    assert R.unmatched_count(found.withColumn("kind", F.when(F.col("confidence") == "confirmed", F.col("kind")))).first().unmatched is None
    assert {r.drift for r in R.discrepancy(found).collect()} <= {"host", "port", "subdomain", "address_literal"}
    hooks = lambda *s: R.runtime_state(spark.createDataFrame([(x,) for x in s], "status string")).first().state
    assert [hooks("degraded", "instrumented"), hooks("degraded"), hooks("no_hook"), hooks("no_hook", "other")] == ["instrumented", "degraded", "no_hook", "unknown"]
    none = spark.createDataFrame([], "language string")
    assert R.runtime_coverage(none).count() == 10 and R.runtime_coverage(spark.createDataFrame([("python",)], "language string")).collect()[0].status == "uninstrumented"
    windows = lambda *w: R.window_fold(spark.createDataFrame([(x,) for x in w], "window_ms long")).first().window_ms
    assert windows(5, 3) == 3 and windows(5, None) is None and windows() is None
    refs = spark.createDataFrame([([("flow", "f"), ("egress_event", "e"), ("flow", "g")],)], "refs array<struct<ref_type:string,ref_id:string>>")
    row = refs.select(R.sole_ref(F.col("refs"), "egress_event").alias("one"), R.sole_ref(F.col("refs"), "flow").alias("none"), R.contributing_sources(F.col("refs"), F.lit(None).cast("array<string>")).alias("of")).first()
    assert (row.one, row.none, row.of) == ("e", None, ["observed-app", "observed-wire"])


def test_governed_types():
    from ledgerline.operators import mask as M

    assert M.governed_types([M.Rule("mask", (), "EMAIL")], "allow") == ["EMAIL"] and "DATE" not in M.governed_types([], "mask")


def brute_episodes(rows, limit=1000):
    """(flow_id, start, end, bytes, flows, provider) by the definition: a running maximum of ends over each conversation's sorted flows."""
    talks = {}
    for r in rows:
        talks.setdefault((r[3], r[5], r[6], r[7], r[9], r[10]), []).append((r[1] * 1000, r[1] * 1000 + r[2], r[0], r[13], r[11]))
    out = []
    for own in talks.values():
        reach = None
        for start, end, i, size, provider in sorted(own):
            if reach is None or start - reach > limit:
                out.append([i, start, end, size, 1, provider])
            else:
                e = out[-1]
                sizes = [x for x in (e[3], size) if x is not None]
                out[-1] = [min(e[0], i), e[1], max(e[2], end), sum(sizes) if sizes else None, e[4] + 1, e[5]]
            reach = end if reach is None or start - reach > limit else max(reach, end)
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("cell_ms", [2_000, 7_000, 900_000])
def test_episodes_meet_across_cells(spark, cell_ms):
    rng = random.Random(cell_ms)
    rows = [flow(i, start=rng.randint(0, 200), ms=rng.choice([0, 300, 1500, 40_000 if rng.random() < 0.05 else 10]), host=rng.choice(["a.example", "b.example"]), port=rng.choice([443, 8443]), provider=f"p{i % 9}", bytes_out=rng.choice([None, i])) for i in range(400)]
    got = E.episodes(flows(spark, *rows), cell_ms=cell_ms).select("flow_id", "start_ms", "end_ms", "bytes_out", "flows", "provider_ref").collect()
    assert sorted(map(tuple, got), key=repr) == brute_episodes(rows)


def test_a_hot_conversation_is_the_work_of_its_cells(spark):
    from pyspark.sql import functions as F

    made = spark.range(200_000).select(F.concat(F.lit("fl_"), F.col("id")).alias("flow_id"), (F.col("id") * 7 % 86_400 + F.when(F.col("id") % 86_400 > 80_000, 5000).otherwise(0)).alias("t_start_bucket"), (F.col("id") % 3 * 400).alias("duration_ms"), F.lit("h.example").alias("resolved_host"), F.lit("10.0.0.1").alias("dst_ip"),
        F.lit(443).alias("dst_port"), F.lit(1).cast("long").alias("pid"), F.lit(5).cast("long").alias("pid_start_time"), F.lit("curl").alias("comm"), F.lit("in_scope").alias("flow_scope"), F.lit("kernel_attributed").alias("process_attribution"), F.lit("p").alias("provider_ref"), F.lit("classified").alias("classification"), F.col("id").alias("bytes_out"))
    own = E.pieces(made)
    assert own.groupBy(*E.CONVERSATION, "cell").count().agg(F.max("count")).first()[0] <= E.CELL_MS // 1000
    whole = E.episodes(made).agg(F.sum("flows"), F.sum("bytes_out"), F.min("start_ms"), F.count("*")).first()
    assert whole[0] == 200_000 and whole[1] == 199_999 * 100_000
    wide = E.episodes(made, cell_ms=10**12)
    assert E.episodes(made).exceptAll(wide).count() == 0 and wide.count() == whole[3]


def brute_names(asked, told):
    return {i: sorted({n for ip2, n, since, ttl in told if ip == ip2 and since is not None and at is not None and since <= at < since + min(max(ttl, 30), 3600)}) for i, ip, at in asked}


def test_names_at_a_time_agree_with_brute_force(spark):
    rng = random.Random(8)
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randint(0, 9000)])) for i in range(500)]
    told = [(rng.choice(["a", "b"]), f"n{rng.randint(0, 12)}", rng.randint(0, 9000), rng.choice([0, 31, 700, 5000])) for _ in range(150)] + [(None, "x", 1, 1), ("a", None, 1, 1)]
    f, a = spark.createDataFrame(asked, "flow_id long, dst_ip string, at long"), spark.createDataFrame(told, "ip string, name string, at long, ttl long")
    got = {r.flow_id: r.dns_names for r in J.named_at(f, a).collect()}
    assert got == brute_names(asked, [t for t in told if t[0] and t[1]])
    assert J.named_at(f.limit(0), a).count() == 0 and {tuple(r.dns_names) for r in J.named_at(f, a.limit(0)).collect()} == {()}


def test_a_hot_address_is_swept_in_its_seconds(spark):
    """One address holds nearly all flows and answers: each group that is put in order has the seconds of a cell at most."""
    from pyspark.sql import functions as F

    answers = spark.range(100_000).select(F.lit("hot").alias("ip"), F.concat(F.lit("n"), F.col("id") % 5).alias("name"), (F.col("id") % 7200).alias("at"), (F.col("id") % 90).alias("ttl"))
    flows_ = spark.range(200_000).select(F.col("id").alias("flow_id"), F.lit("hot").alias("dst_ip"), (F.col("id") * 31 % 10_000).alias("at"))
    spans = J.merged_spans(answers)
    assert spans.groupBy("ip", "name", "cell").count().agg(F.max("count")).first()[0] <= 3600 and spans.count() < 5 * 7300
    got = J.named_at(flows_, answers).groupBy(F.size("dns_names").alias("n")).count().collect()
    assert sum(r["count"] for r in got) == 200_000 and {r.n for r in got} >= {0, 5}
    some = J.named_at(flows_.filter("flow_id < 300"), answers).collect()
    told = [("hot", f"n{i % 5}", i % 7200, i % 90) for i in range(100_000)]
    near = lambda at: [t for t in told if at - 90 <= t[2] <= at]
    assert all(r.dns_names == brute_names([(0, "hot", r.flow_id * 31 % 10_000)], near(r.flow_id * 31 % 10_000))[0] for r in some[:60])


def test_members_of_episodes_meet_across_cells(spark):
    rng = random.Random(31)
    rows = [flow(i, start=rng.randint(0, 120), ms=rng.choice([0, 300, 1500, 30_000 if rng.random() < 0.1 else 10]), host=rng.choice(["a.example", "b.example"]), pid=rng.choice([1, None])) for i in range(250)]
    own = E.members(flows(spark, *rows), cell_ms=5_000).collect()
    assert sorted(r.member for r in own) == sorted(r[0] for r in rows)
    sizes = {}
    for r in own:
        key = (r.flow_id, r.host, r.pid)
        sizes[key] = sizes.get(key, 0) + 1
    whole = {(r.flow_id, r.host, r.pid): r.flows for r in E.episodes(flows(spark, *rows)).collect()}
    assert sizes == whole and len(whole) > 10


def test_findings_hold_references_and_tell_what_a_collapse_lost(spark):
    p = points(spark, ("op.a", "a.example", None, "p1"), ("op.b", "b.example", None, "p2"))
    e = events(spark, ("op.a", "c.example", None, "p1"), ("op.a", "d.example", None, "p1"), ("op.a", "a.example", None, "p1"))
    f = flows(spark, flow(3, host="u.example"), flow(1, host="u.example"), flow(2, start=1001, host="u.example"), flow(9, start=5000, host="u.example"))
    found = D.findings(p, e, f)[0]
    whole = {r.primary_ref: r for r in D.collapsed(found, D.references(p, e, f)).collect()}
    assert [tuple(r) for r in whole["ep_0"].refs] == [("egress_event", "ee_0"), ("egress_event", "ee_1"), ("egress_point", "ep_0")] and whole["ep_0"].kind == "target_drift"
    assert [tuple(r) for r in whole["ep_1"].refs] == [("egress_point", "ep_1")] and whole["ep_1"].kind == "dormant_egress_point"
    assert [r.ref_id for r in whole["fl_1"].refs] == ["fl_1", "fl_2", "fl_3"] and [r.ref_id for r in whole["fl_9"].refs] == ["fl_9"]
    assert D.fault_notes(D.collapsed(found, D.references(p, e, f))).count() == 0
    from pyspark.sql import functions as F

    twice = D.collapsed(found.unionByName(found.withColumn("evidence", F.lit("another"))), D.references(p, e, f))
    assert all(r.lost == 1 and len(r.evidence) == 2 and "another" in r.evidence for r in twice.collect())
    assert D.fault_notes(twice).first().fault == f"{found.count()} findings collapsed onto an identity that another one already held"


def test_reference_digests_are_those_of_the_gathered_references(spark):
    """Also of a point that is told twice and of a flow id with two targets, which refer to two lists each."""
    import hashlib

    p = points(spark, ("op.a", "a.example", None, "p1"), ("op.a", "a.example", None, "p2"), ("op.b", "b.example", 81, "p2"), (None, "c.example", None, "p3"), ("op.c", None, None, "p4"))
    p = p.unionByName(points(spark, ("op.b", "b.example", 81, "p1")))
    e = events(spark, ("op.a", "c.example", None, "p1"), ("op.a", "d.example", 81, "p1", 1), ("op.a", "a.example", None, "p1"), ("op.b", "a.example", None, "p1"), ("op.b", "b.example", None, "p1", 1))
    f = flows(spark, flow(3, host="c.example"), flow(1, host="c.example"), flow(4, host="d.example", port=81, flow_id="fl_1"), flow(2, host="u.example"), flow(5, start=9000, host="b.example", bytes_out=10**6), flow(6, host=None))
    found = D.findings(p, e, f)[0]
    want = {}
    for r in D.collapsed(found, D.references(p, e, f)).collect():
        want[r.finding_id] = (r.kind, len(r.refs), hashlib.sha256(",".join(f"{x.ref_type}:{x.ref_id}" for x in r.refs).encode()).hexdigest())
    got = D.reference_digests(found, p, e, f)
    assert {r.finding_id: (r.kind, r.n_refs, r.refs_sha256) for r in got.collect()} == want
    assert {k for k, _, _ in want.values()} >= {"target_drift", "unmatched_wire_traffic", "volume_anomaly"} and got.count() == len(want)


def test_links_of_one_operation_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "SIDE", 40, raising=False)
    points = spark.range(0, 300, 1, 1).selectExpr("concat('ep', id) ep_id", "if(id < 250, 'op', null) operation", "if(id % 3 = 0, 'h', null) host", "if(id % 2 = 0, 443, null) port", "if(id % 5 = 0, 'unknown', 'p') provider_ref")
    events = spark.range(0, 200, 1, 1).selectExpr("concat('ee', id) ee_id", "if(id < 150, 'op', 'other') ee_operation", "if(id % 7 = 0, 'unknown', 'p') ee_provider", "if(id % 2 = 0, 'h', null) obs_host", "if(id % 4 = 0, 443, null) obs_port")
    found = J.links(points, events)
    want = {}
    for p in points.collect():
        for e in events.collect():
            same = p.host is not None and (p.host, p.port) == (e.obs_host, e.obs_port)
            tier = (0 if same else 1) if p.operation == e.ee_operation else 2 if same else 3 if p.provider_ref == e.ee_provider != "unknown" else None
            if tier is not None:
                want[p.ep_id, e.ee_id] = tier
    got = [((r.ep_id, r.ee_id), r.tier) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want)
    by_task = found.filter("tier < 2").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) >= 3 and max(r["count"] for r in by_task) < 0.6 * sum(r["count"] for r in by_task)
