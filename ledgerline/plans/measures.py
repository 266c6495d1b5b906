"""Queries that put single operators to work on rows made from the driver's tables, with the SQL that each must agree with.

A row set is written once as SQL over one table, which Spark and DuckDB both run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import checksums as K
from ledgerline.functions import identity as I
from ledgerline.functions import payloads as P
from ledgerline.functions import targets as T
from ledgerline.operators import derive as D
from ledgerline.operators import detect as X
from ledgerline.operators import episodes as E
from ledgerline.operators import flows as W
from ledgerline.operators import gateway as G
from ledgerline.operators import mask as M
from ledgerline.operators import report as R
from ledgerline.operators import validate as V
from ledgerline.plans import relational as Q
from ledgerline.plans import textual as Y
from ledgerline.plans import views
from ledgerline.sources import packets as B
from ledgerline.streaming import restorer as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


class Rows:
    """Rows made by one SQL text over one table, named {t} in it."""

    def __init__(self, table: str, sql: str) -> None:
        self.table, self.sql = table, sql

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(self.sql.replace("{", "{{").replace("}", "}}").replace("{{t}}", "{src}"), src=spark.read.parquet(f"{sf_dir}/{self.table}.parquet"))

    @property
    def duck(self) -> str:
        return self.sql.replace("{t}", self.table)


RECORDS = Rows(
    "orders",
    """SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 37 = 1 THEN 'fl_XY' ELSE 'fl_' || lpad(CAST(o_orderkey AS STRING), 16, '0') END AS flow_id,
  CASE WHEN o_orderkey % 41 = 2 THEN 'P 1' WHEN o_custkey % 7 = 0 THEN 'unknown' ELSE 'p' || CAST(o_custkey % 7 AS STRING) END AS provider_ref,
  CASE WHEN o_orderkey % 43 = 3 THEN 'sni.example' ELSE NULL END AS sni, CASE WHEN o_orderkey % 86 = 3 THEN 'client_hello' ELSE 'absent' END AS sni_source,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'h.example' END AS resolved_host, CASE WHEN o_orderkey % 8 = 0 OR o_orderkey % 47 = 4 THEN 'none' ELSE 'dns' END AS resolved_host_source,
  CASE WHEN o_orderkey % 53 = 5 THEN 'opaque' WHEN o_custkey % 7 <> 0 THEN 'classified' WHEN o_orderkey % 8 = 0 THEN 'opaque' ELSE 'unclassified' END AS classification,
  CASE WHEN o_orderkey % 59 = 6 THEN 'high' ELSE NULL END AS provider_confidence, CASE WHEN o_orderkey % 61 = 7 AND o_custkey % 7 <> 0 THEN '1.x' ELSE NULL END AS ruleset_version,
  CASE WHEN o_orderkey % 67 = 8 THEN 'unattributed' ELSE 'inferred' END AS process_attribution, o_custkey % 4 AS pid,
  CASE WHEN o_orderkey % 71 = 9 THEN '/usr/bin/python' ELSE 'python' END AS exe FROM {t}""",
)


@_query(
    rf"""WITH r AS ({RECORDS.duck}), f AS (SELECT CASE WHEN NOT regexp_full_match(flow_id, 'fl_[0-9a-f]{{16}}') THEN 'malformed_flow_id'
  WHEN NOT regexp_full_match(provider_ref, '[a-z0-9][a-z0-9-]*') THEN 'malformed_provider_ref'
  WHEN sni IS NOT NULL AND sni_source <> 'client_hello' THEN 'sni_without_client_hello'
  WHEN NOT CASE classification WHEN 'classified' THEN provider_ref <> 'unknown' WHEN 'unclassified' THEN provider_ref = 'unknown' AND resolved_host IS NOT NULL ELSE provider_ref = 'unknown' AND resolved_host IS NULL END THEN 'classification_without_its_witness'
  WHEN (provider_confidence IS NOT NULL OR ruleset_version IS NOT NULL) AND classification <> 'classified' THEN 'classification_detail_without_classification'
  WHEN NOT regexp_full_match(ruleset_version, '[0-9]+\.[0-9]+\.[0-9]+') THEN 'malformed_ruleset_version'
  WHEN process_attribution NOT IN ('kernel_attributed', 'inferred') THEN 'attribution_disagrees_with_process'
  WHEN (resolved_host IS NOT NULL) <> (resolved_host_source <> 'none') THEN 'resolved_host_source_disagrees'
  WHEN regexp_matches(exe, '[/\\]') THEN 'path_in_record_body' END AS fault FROM r)
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY fault"""
)
def q51_flow_faults(spark, sf_dir):
    rows = RECORDS.spark(spark, sf_dir)
    return V.tally(rows.withColumn("fault", V.flow_fault(rows)), "fault")


@_query(f"WITH r AS ({RECORDS.duck}) SELECT CASE WHEN provider_ref <> 'unknown' THEN 'classified' WHEN resolved_host IS NOT NULL THEN 'unclassified' ELSE 'opaque' END AS class, count(*) AS n FROM r GROUP BY 1")
def q52_classification(spark, sf_dir):
    return RECORDS.spark(spark, sf_dir).groupBy(V.classification(F.col("provider_ref"), F.col("resolved_host")).alias("class")).agg(F.count("*").alias("n"))


@_query(Q._with("SELECT s.scope, count(f.flow_id) AS n FROM (VALUES ('in_scope', 'in_scope'), ('out_of_scope', 'out_of_scope_process'), ('known_benign', 'known_benign'), ('undetermined', 'undetermined')) s(scope, own) LEFT JOIN flow f ON f.flow_scope = s.own GROUP BY s.scope"))
def q53_scope_tally(spark, sf_dir):
    return E.scope_tally(views.flows(spark, sf_dir))


def _twice_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows, every tenth of which was read a second time, later and with more bytes."""
    flows = views.flows(spark, sf_dir)
    again = flows.filter("flow_id like '%3'").withColumns({"bytes_out": F.col("bytes_out") + 500, "duration_ms": F.col("duration_ms") + 200, "classification": F.lit("opaque")})
    return flows.unionByName(again)


@_query(
    Q._with(
        """SELECT flow_id, coalesce(resolved_host, dst_ip) AS host, CASE WHEN dst_port NOT IN (80, 443) THEN dst_port END AS port, pid, min(t_start_bucket * 1000) AS start_ms, max(t_start_bucket * 1000 + duration_ms) AS end_ms,
  max(bytes_out) AS bytes_out, max(CASE classification WHEN 'classified' THEN 1 WHEN 'unclassified' THEN 2 ELSE 3 END) AS class_rank, bool_and(resolved_host IS NOT NULL) AS named, arg_min(provider_ref, t_start_bucket * 1000 + duration_ms) AS provider_ref
  FROM twice GROUP BY flow_id, host, port, pid, pid_start_time, flow_scope, process_attribution""",
        "twice AS (SELECT * FROM flow UNION ALL SELECT * REPLACE (bytes_out + 500 AS bytes_out, duration_ms + 200 AS duration_ms, 'opaque' AS classification) FROM flow WHERE flow_id LIKE '%3')",
    )
)
def q54_duplicate_readings(spark, sf_dir):
    return E.readings(_twice_read(spark, sf_dir)).select("flow_id", "host", "port", "pid", "start_ms", "end_ms", "bytes_out", "class_rank", "named", "provider_ref")


_SIZED = Q._CALLS.replace("FROM event WHERE", "FROM event WHERE byte_size_estimate > 0 AND")


@_query(Q._with("SELECT * FROM volume", Q._EPISODE, _SIZED, Q._VOLUME))
def q55_volume_of_sized_calls(spark, sf_dir):
    return D.volume(Q._events(spark, sf_dir).filter("byte_size_estimate > 0"), views.flows(spark, sf_dir), Q.SETTINGS)


HOOKS = Rows(
    "events",
    """SELECT user_id % 4 AS part, event_id % 3 AS third, CASE user_id % 4 WHEN 0 THEN 'no_hook' WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN 'degraded' ELSE 'no_hook' END
  WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'instrumented' WHEN 1 THEN 'degraded' ELSE 'no_hook' END ELSE CASE WHEN event_id % 2 = 0 THEN 'no_hook' ELSE 'unclear' END END AS status,
  CASE WHEN user_id % 4 = 1 AND event_id % 100 = 0 THEN NULL ELSE 60000 + event_id * 10 END AS window_ms,
  CASE user_id % 4 WHEN 0 THEN 'ebpf' WHEN 1 THEN CASE WHEN event_id % 50 = 0 THEN 'pcap' ELSE 'ebpf' END ELSE NULL END AS mechanism,
  CASE WHEN user_id % 4 = 2 AND event_id % 20 = 0 THEN 853 ELSE 443 END AS dst_port, CASE WHEN user_id % 4 = 3 THEN event_id % 2 ELSE 0 END AS answers,
  CASE WHEN user_id % 4 = 1 AND event_id % 70 = 0 THEN NULL ELSE event_id % 3 END AS lost, CASE WHEN event_id % 4 = 0 THEN 404 ELSE 200 END AS code, event_id % 6 AS hidden, event_id % 2 AS broken FROM {t}""",
)


def _each_part(spark: SparkSession, sf_dir: str, what: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """What an operator of one row says of each part, and of no rows at all (part -1)."""
    rows = HOOKS.spark(spark, sf_dir)
    parts = [what(rows.filter(f"part = {k}")).withColumn("part", F.lit(k)) for k in range(4)] + [what(rows.limit(0)).withColumn("part", F.lit(-1))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("part", column)


def _parts_sql(expression: str) -> str:
    return f"WITH h AS ({HOOKS.duck}) SELECT p.part, {expression} FROM (VALUES (-1), (0), (1), (2), (3)) p(part) LEFT JOIN h ON h.part = p.part GROUP BY p.part"


@_query(_parts_sql("CASE WHEN bool_or(status = 'instrumented') THEN 'instrumented' WHEN bool_or(status = 'degraded') THEN 'degraded' WHEN bool_and(status = 'no_hook') THEN 'no_hook' ELSE 'unknown' END AS state"))
def q56_runtime_state(spark, sf_dir):
    return _each_part(spark, sf_dir, R.runtime_state, "state")


@_query(_parts_sql("CASE WHEN count(*) = count(window_ms) THEN min(window_ms) END AS window_ms"))
def q57_window_fold(spark, sf_dir):
    return _each_part(spark, sf_dir, R.window_fold, "window_ms")


@_query(_parts_sql("CASE WHEN bool_or(mechanism IN ('pcap', 'etw')) THEN 'none' WHEN bool_or(mechanism = 'ebpf') THEN 'linux_ebpf' ELSE 'none' END AS platform"))
def q58_platform_class(spark, sf_dir):
    return _each_part(spark, sf_dir, R.platform_class, "platform")


@_query(_parts_sql("bool_or(dst_port = 853) AND coalesce(sum(answers), 0) = 0 AS encrypted_dns"))
def q59_encrypted_dns(spark, sf_dir):
    return _each_part(spark, sf_dir, W.encrypted_dns, "encrypted_dns")


@_query(_parts_sql("CASE WHEN count(h.part) > 0 AND count(h.part) = count(lost) THEN sum(lost) END AS lost"))
def q60_loss(spark, sf_dir):
    return _each_part(spark, sf_dir, W.loss, "lost")


@_query(f"WITH h AS ({HOOKS.duck}) SELECT count(*) AS requests, count(*) FILTER (code >= 400) AS refusals, sum(hidden)::BIGINT AS masked, sum(broken)::BIGINT AS reassembly_errors FROM h")
def q61_request_counters(spark, sf_dir):
    return W.request_counters(HOOKS.spark(spark, sf_dir).selectExpr("code as status", "hidden as masked", "broken as reassembly_errors"))


LINES = Rows(
    "lineitem",
    """SELECT l_orderkey AS request_id, l_linenumber AS line, CASE l_partkey % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PERSON' ELSE 'IBAN' END AS entity,
  CASE l_suppkey % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'invalid' WHEN 2 THEN 'label' ELSE 'opaque' END AS rung, l_linenumber % 3 = 0 AS reused,
  's' || CAST(((l_linenumber % 3) * 100 + l_partkey % 100) % 7 AS STRING) AS scope, l_linenumber % 3 AS path_no, l_partkey % 100 AS start, 'v' || CAST(l_partkey % 4 AS STRING) AS value,
  CASE l_partkey % 5 WHEN 0 THEN 'unmasked_and_declared' ELSE 'masked_round_trip' END AS treatment, l_suppkey % 7 = 0 AS tool_arguments, 'p' || CAST(l_suppkey % 3 AS STRING) AS provider_ref FROM {t}""",
)


@_query(f"WITH s AS ({LINES.duck}) SELECT request_id, entity, count(*) AS n, ['reserved', 'invalid', 'label', 'opaque'][max(list_position(['reserved', 'invalid', 'label', 'opaque'], rung))] AS rung FROM s WHERE NOT reused GROUP BY ALL")
def q62_alias_stats(spark, sf_dir):
    return G.alias_stats(LINES.spark(spark, sf_dir))


@_query(f"WITH s AS ({LINES.duck}) SELECT request_id, entity, count(*) AS n, arg_min(scope, path_no * 1000 - start) AS scope FROM s GROUP BY request_id, entity")
def q63_allowed_stats(spark, sf_dir):
    return G.allowed_stats(LINES.spark(spark, sf_dir))


@_query(f"""WITH s AS ({LINES.duck}), f AS (SELECT request_id, entity, value, min(line) AS at_ FROM s GROUP BY ALL)
SELECT request_id AS session, entity, value, at_ AS "at", entity || '_' || row_number() OVER (PARTITION BY request_id, entity ORDER BY at_, value)::VARCHAR AS label FROM f""")
def q64_label_numbers(spark, sf_dir):
    return G.label_numbers(LINES.spark(spark, sf_dir).selectExpr("request_id as session", "entity", "value", "line as at"))


@_query(f"""WITH s AS ({LINES.duck}), r AS (SELECT scope, provider_ref, CASE WHEN treatment = 'unmasked_and_declared' THEN 'endpoint_unsupported_passthrough' WHEN tool_arguments THEN 'tool_arguments_passthrough' END AS rule_id FROM s)
SELECT scope, provider_ref, rule_id, count(*) AS requests, 'unmasked_passthrough' AS kind, 'confirmed' AS confidence, 'fnd_' || substr(sha256(scope || chr(31) || provider_ref || chr(31) || rule_id), 1, 16) AS finding_id FROM r WHERE rule_id IS NOT NULL GROUP BY scope, provider_ref, rule_id""")
def q65_declared_passthrough(spark, sf_dir):
    return G.declared_passthrough(LINES.spark(spark, sf_dir))


@_query("""WITH r AS (SELECT event_id AS id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT id, (SELECT greatest(count(*) - 300, 0) FROM events) AS evicted FROM r WHERE k <= 300""")
def q66_newest(spark, sf_dir):
    return G.newest(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as id", "ts"), 300).select("id", "evicted")


ANSWERS = Rows("events", "SELECT 'ip' || CAST(user_id % 37 AS STRING) AS ip, 'n' || CAST(event_id % 23 AS STRING) AS name, (event_id * 31) % 20000 AS expiry, event_id AS seen FROM {t}")


@_query(f"""WITH a AS ({ANSWERS.duck}), l AS (SELECT ip, name, max(expiry) AS expiry, min(seen) AS seen FROM a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY seen, name) AS r FROM l), t AS (SELECT ip FROM k WHERE r <= 5 GROUP BY ip ORDER BY max(expiry) DESC, ip DESC LIMIT 20)
SELECT ip, name, expiry FROM k WHERE r <= 5 AND ip IN (SELECT ip FROM t)""")
def q67_dns_capacity(spark, sf_dir):
    return W.bounded_names(ANSWERS.spark(spark, sf_dir).withColumnRenamed("seen", "at"), addresses=20, names=5)


@_query("""WITH f AS (SELECT 'fl_' || (o_orderkey % 500)::VARCHAR AS flow_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS netns FROM orders)
SELECT flow_id, count(*) AS n FROM f GROUP BY flow_id HAVING count(DISTINCT coalesce(netns::VARCHAR, '-')) > 1""")
def q68_shared_flow_ids(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return W.shared_flow_ids(orders.select(F.concat(F.lit("fl_"), (F.col("o_orderkey") % 500).cast("string")).alias("flow_id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderkey") % 2).alias("netns")))


FILES = Rows("part", "SELECT 'src/f' || CAST(p_partkey AS STRING) || '.py' AS path, CASE p_partkey % 10 WHEN 0 THEN 'unread' WHEN 1 THEN 'partial' ELSE 'parsed' END AS state, CASE WHEN p_partkey % 30 = 0 THEN 'binary' WHEN p_partkey % 10 = 0 THEN 'too_large' ELSE NULL END AS reason FROM {t}")


@_query(f"""WITH f AS ({FILES.duck}), c AS (SELECT count(*) FILTER (state <> 'unread') AS p, count(*) FILTER (state = 'partial') AS q, count(*) FILTER (state = 'unread') AS u, count(*) FILTER (state = 'unread' AND reason NOT IN ('binary', 'skipped_non_code')) AS k FROM f)
SELECT p AS parsed_files, q AS partial_files, u AS unread_files, k AS unread_counting, CASE WHEN p + k = 0 THEN 0 ELSE least(10000, (k * 10000 + p + k - 1) // (p + k)) END AS unparsed_ratio_bp FROM c""")
def q69_coverage(spark, sf_dir):
    return R.coverage(FILES.spark(spark, sf_dir))


@_query(f"WITH f AS ({FILES.duck}) SELECT path, reason, (SELECT count(*) FROM f WHERE state = 'unread') AS total FROM f WHERE state = 'unread' ORDER BY path LIMIT 100")
def q70_unread_files(spark, sf_dir):
    return R.unread(FILES.spark(spark, sf_dir))


@_query(Q._with("SELECT 'scan_' || substr(sha256('scan/v1' || chr(31) || string_agg(DISTINCT finding_id, chr(31) ORDER BY finding_id)), 1, 16) AS scan_id FROM finding", *Q._ALL))
def q71_scan_id(spark, sf_dir):
    return R.scan_id(Q._findings(spark, sf_dir))


@_query(Q._with("SELECT count(*) FILTER (kind = 'unmatched_wire_traffic') AS unmatched FROM finding", *Q._ALL))
def q72_unmatched_count(spark, sf_dir):
    return R.unmatched_count(Q._findings(spark, sf_dir))


@_query(Q._with("SELECT finding_id, provider_ref, confidence, rule_id, NULL::VARCHAR AS place FROM finding", *Q._ALL))
def q73_condensed(spark, sf_dir):
    return R.condensed(Q._findings(spark, sf_dir))


@_query(Q._with("SELECT count(*) FILTER (confidence = 'suspect') + count(*) FILTER (kind = 'target_drift' AND confidence <> 'suspect') AS disagreements FROM finding", *Q._ALL))
def q74_disagreements(spark, sf_dir):
    found = Q._findings(spark, sf_dir)
    return R.disagreements(found, found.filter("kind = 'target_drift'"))


@_query(
    Q._with(
        """SELECT finding_id, arg_min(drift, step) AS drift, arg_min(declared, step) AS declared, arg_min(observed, step) AS observed, count(DISTINCT (drift, declared, observed)) > 1 AS several
  FROM (SELECT finding_id, step, regexp_extract(t, ' drift=([^ ]*)', 1) AS drift, regexp_extract(t, ' declared=([^ ]*)', 1) AS declared, regexp_extract(t, ' observed=([^ ]*)', 1) AS observed
    FROM (SELECT finding_id, unnest(string_split(evidence, '; ')) AS t, generate_subscripts(string_split(evidence, '; '), 1) AS step FROM finding) WHERE step <= 25) WHERE drift <> '' GROUP BY finding_id""",
        *Q._ALL,
    )
)
def q75_discrepancy(spark, sf_dir):
    return R.discrepancy(Q._findings(spark, sf_dir))


REFS = Rows("lineitem", "SELECT l_orderkey AS id, CASE l_partkey % 4 WHEN 0 THEN 'egress_point' WHEN 1 THEN 'egress_event' WHEN 2 THEN 'flow' ELSE 'note' END AS ref_type, 'r' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS ref_id FROM {t}")


@_query(f"""WITH r AS ({REFS.duck}) SELECT id, CASE WHEN count(*) FILTER (ref_type = 'flow') = 1 THEN min(ref_id) FILTER (ref_type = 'flow') END AS only_flow,
  array_to_string(list_sort(list_distinct(list(CASE ref_type WHEN 'egress_point' THEN 'declared' WHEN 'egress_event' THEN 'observed-app' ELSE 'observed-wire' END) FILTER (ref_type <> 'note'))), ',') AS sources FROM r GROUP BY id""")
def q76_references(spark, sf_dir):
    refs = REFS.spark(spark, sf_dir).groupBy("id").agg(F.collect_list(F.struct("ref_type", "ref_id")).alias("refs"))
    sources = R.contributing_sources(F.col("refs"), F.lit(None).cast("array<string>"))
    return refs.select("id", R.sole_ref(F.col("refs"), "flow").alias("only_flow"), F.when(F.size(sources) > 0, F.array_join(sources, ",")).alias("sources"))


@_query("""WITH m AS (SELECT event_id, ['full', 'static_only', 'static_runtime', 'static_wire', 'other'][event_id % 5 + 1] AS mode FROM events)
SELECT event_id, CASE WHEN mode IN ('full', 'static_wire') THEN 'running' WHEN mode = 'other' THEN 'unknown' ELSE 'not_running' END AS sensor,
  CASE mode WHEN 'full' THEN 'declared,observed-app,observed-wire' WHEN 'static_runtime' THEN 'declared,observed-app' WHEN 'static_wire' THEN 'declared,observed-wire' ELSE 'declared' END AS sources FROM m""")
def q77_sensor_state(spark, sf_dir):
    mode = F.element_at(F.array(*map(F.lit, ["full", "static_only", "static_runtime", "static_wire", "other"])), (F.col("event_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", R.sensor_state(mode).alias("sensor"), F.array_join(R.sources_present(mode), ",").alias("sources"))


@_query("""WITH l AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'java' END AS language FROM documents)
SELECT 'some' AS run, language, 'uninstrumented' AS status FROM l WHERE language IS NOT NULL
UNION ALL SELECT 'none', unnest(['csharp', 'go', 'java', 'javascript', 'kotlin', 'php', 'python', 'ruby', 'rust', 'typescript']), 'unsupported'""")
def q78_runtime_coverage(spark, sf_dir):
    lang = F.col("lang")
    seen = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(lang == "en", "python").when(lang == "de", "go").when(lang == "fr", "java").alias("language"))
    return R.runtime_coverage(seen).withColumn("run", F.lit("some")).unionByName(R.runtime_coverage(seen.filter("language is null")).withColumn("run", F.lit("none")))


BODIES = Rows("customer", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no json' ELSE '{"model":"m","messages":[{"role":"user","content":"' || c_mktsegment || '"},{"role":"user","content":null}],"n":' || CAST(c_custkey AS STRING) || ',"Odd Key":{"x":"' || c_mktsegment || '"}}' END AS body FROM {t}""")


@_query(f"""WITH b AS ({BODIES.duck}) SELECT c_custkey, CASE WHEN body LIKE '{{%' THEN 'messages[].content,messages[].role,model,n,<dyn>.x' ELSE '' END AS paths,
  CASE WHEN body LIKE '{{%' THEN 1 + 4 + 4 + 4 + 8 + 2 * length(json_extract_string(body, '$.messages[0].content')) ELSE 0 END AS bytes, CASE WHEN body LIKE '{{%' THEN NULL ELSE 0 END AS stopped FROM b""".replace("'messages[].content,messages[].role,model,n,<dyn>.x'", "'<dyn>.x,messages[].content,messages[].role,model,n'"))
def q79_payload_shape(spark, sf_dir):
    shaped = BODIES.spark(spark, sf_dir).withColumn("s", P.payload_shape(F.col("body")))
    return shaped.select("c_custkey", F.array_join("s.field_paths", ",").alias("paths"), F.col("s.byte_size_estimate").alias("bytes"), F.col("s.truncated_depth").alias("stopped"))


@_query(f"""WITH b AS (SELECT * FROM ({BODIES.duck}) WHERE body LIKE '{{%')
SELECT c_custkey, unnest(['model', 'messages[0].role', 'messages[0].content', 'messages[1].role', 'Odd Key.x']) AS path, unnest(['m', 'user', json_extract_string(body, '$.messages[0].content'), 'user', json_extract_string(body, '$."Odd Key".x')]) AS text FROM b""")
def q80_text_leaves(spark, sf_dir):
    return BODIES.spark(spark, sf_dir).select("c_custkey", F.explode(P.leaves(F.col("body"))).alias("l")).select("c_custkey", "l.path", "l.text")


@_query("""SELECT o_orderkey, 'fl_' || substr(sha256('fl/v1' || chr(31) || 'host' || (o_custkey % 5)::VARCHAR || chr(31) || 'boot' || chr(31) || (o_orderkey % 60000)::VARCHAR || '/10.0.0.1/443/tcp' || chr(31) || (o_orderkey // 7)::VARCHAR), 1, 16) AS flow_id,
  'h_' || substr(sha256('host/v1' || chr(31) || 'host' || (o_custkey % 5)::VARCHAR), 1, 16) AS host_id FROM orders""")
def q81_identities(spark, sf_dir):
    host = F.concat(F.lit("host"), (F.col("o_custkey") % 5).cast("string"))
    flow = I.flow_identity(host, F.lit("boot"), F.col("o_orderkey") % 60000, F.lit("10.0.0.1"), F.lit(443), F.lit("tcp"), F.expr("o_orderkey div 7"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", flow.alias("flow_id"), I.host_identity(host).alias("host_id"))


@_query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'no url' WHEN page_id % 9 = 1 THEN replace(url, '://', '://User@') ELSE url END AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '://(?:User@)?([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme FROM u)
SELECT page_id, CASE WHEN host = '' THEN 'unknown' ELSE host END AS host_id, CASE WHEN host = '' THEN NULL WHEN scheme = 'https' THEN 443 WHEN scheme = 'http' THEN 80 END AS port, 'unknown' AS provider_ref FROM p""")
def q82_target_blocks(spark, sf_dir):
    url = F.when(F.col("page_id") % 9 == 0, "no url").when(F.col("page_id") % 9 == 1, F.replace("url", F.lit("://"), F.lit("://User@"))).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("t", T.target_block(url)).select("page_id", "t.host_id", "t.port", "t.provider_ref")


@_query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'f' || p_partkey::VARCHAR || '.py' WHEN 1 THEN 'w' || p_partkey::VARCHAR ELSE '' END AS base FROM part""")
def q83_base_names(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src/a/f"), key, F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("C:\\x\\w"), key)).otherwise(F.lit("dir/"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.base_name(path).alias("base"))


REQUESTS = Rows(
    "lineitem",
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 2 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, CASE l_suppkey % 12 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/models' WHEN 2 THEN '/v1/images/generations' WHEN 3 THEN '/v1/imagesque'
  WHEN 4 THEN '/v1/responses' WHEN 5 THEN '/admin/metrics' WHEN 6 THEN '/admin/other' WHEN 7 THEN '/v1/messages' WHEN 8 THEN '/anthropic/v1/messages' WHEN 9 THEN '/_ledgerline/session/' || CAST(l_partkey % 3 AS STRING) WHEN 10 THEN '/_ledgerline/session/a/b' ELSE '/v1/threads/t1/runs' END AS path FROM {t}""",
)


@_query(f"""WITH r AS ({REQUESTS.duck}) SELECT l_orderkey, l_linenumber, CASE
  WHEN path = '/admin/metrics' THEN CASE method WHEN 'GET' THEN 'own' ELSE 'method_not_allowed' END
  WHEN path LIKE '/\\_ledgerline/session/%' ESCAPE '\\' THEN CASE WHEN method <> 'GET' THEN 'method_not_allowed' WHEN path LIKE '%/a/b' THEN 'not_found' ELSE 'own' END
  WHEN path IN ('/admin/other', '/v1/messages', '/v1/imagesque') THEN 'not_found' WHEN path = '/v1/images/generations' THEN 'endpoint_unsupported' WHEN path IN ('/v1/responses', '/v1/threads/t1/runs') THEN 'unmasked_and_declared'
  WHEN path = '/v1/models' THEN CASE method WHEN 'GET' THEN 'no_user_text' ELSE 'method_not_allowed' END ELSE CASE method WHEN 'POST' THEN 'masked_round_trip' ELSE 'method_not_allowed' END END AS treatment FROM r""".replace("\\\\", "\\"))
def q84_treatments(spark, sf_dir):
    return REQUESTS.spark(spark, sf_dir).select("l_orderkey", "l_linenumber", G.treatment(F.col("method"), F.col("path")).alias("treatment"))


HELLOS = Rows("events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'server_name' WHEN 1 THEN 'encrypted' ELSE NULL END AS hello, CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(user_id % 3 AS STRING) ELSE NULL END AS own, user_id % 4 AS answers, event_id % 2 = 0 AS hidden_dns, event_id % 5 = 0 AS dropped FROM {t}")


@_query(f"""WITH h AS (SELECT *, list_transform(range(0, answers), lambda x: 'n' || x::VARCHAR) AS names FROM ({HELLOS.duck}))
SELECT event_id, own AS sni, CASE hello WHEN 'server_name' THEN 'client_hello' WHEN 'encrypted' THEN 'encrypted_client_hello' ELSE 'absent' END AS sni_source,
  CASE WHEN hello = 'server_name' THEN own WHEN hello = 'encrypted' THEN NULL ELSE list_min(names) END AS resolved_host,
  CASE WHEN hello = 'server_name' THEN CASE WHEN list_contains(names, own) THEN 'dns_and_sni' ELSE 'sni' END WHEN hello = 'encrypted' OR len(names) = 0 THEN NULL ELSE 'dns' END AS resolved_host_source,
  array_to_string(list_filter([CASE WHEN hello = 'server_name' AND len(names) > 0 AND NOT list_contains(names, own) THEN 'dns_sni_mismatch' END, CASE WHEN hello = 'encrypted' THEN 'ech' END,
    CASE WHEN len(names) = 0 AND hidden_dns THEN 'encrypted_dns' END, CASE WHEN len(names) = 0 AND dropped THEN 'map_overflow' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h""")
def q85_arbitrated_names(spark, sf_dir):
    names = F.when(F.col("answers") > 0, F.transform(F.sequence(F.lit(0), F.col("answers").cast("int") - 1), lambda k: F.concat(F.lit("n"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    said = HELLOS.spark(spark, sf_dir).withColumn("a", W.arbitrated(F.col("hello"), F.col("own"), names, F.col("hidden_dns"), F.col("dropped")))
    return said.select("event_id", "a.sni", "a.sni_source", "a.resolved_host", "a.resolved_host_source", F.array_join("a.degraded_reasons", ",").alias("reasons"))


@_query(f"WITH r AS ({REQUESTS.duck}) SELECT l_orderkey, l_linenumber, 'method=' || method || CASE WHEN l_linenumber % 2 = 0 THEN ' path=' || path ELSE '' END || ' line=' || l_linenumber::VARCHAR AS log FROM r")
def q86_log_lines(spark, sf_dir):
    line = G.log_line({"method": F.col("method"), "path": F.when(F.col("l_linenumber") % 2 == 0, F.col("path")), "line": F.col("l_linenumber")})
    return REQUESTS.spark(spark, sf_dir).select("l_orderkey", "l_linenumber", line.alias("log"))


@_query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Accept' ELSE 'Accept,X-Api-Key' END AS forwarded, CASE WHEN event_id % 4 = 0 THEN 'Accept,Host,X-Ledgerline-Mode' ELSE 'Accept,Host,X-Ledgerline-Mode' END AS told FROM events""")
def q87_headers(spark, sf_dir):
    base = {"Accept": "json", "Host": "h", "X-Ledgerline-Mode": "m"}
    headers = F.map_from_arrays(F.array(*map(F.lit, base), F.when(F.col("event_id") % 4 == 0, "Connection").otherwise("X-Api-Key")), F.array(*map(F.lit, base.values()), F.lit("v")))
    shown = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    told = F.map_filter(G.told_headers(headers), lambda k, _: k != "Connection")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", shown(G.forwarded_headers(headers)).alias("forwarded"), shown(told).alias("told"))


TOOLS = Rows("events", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"tools":[]}' WHEN 1 THEN '{"messages":[{"role":"user","content":"tools"}]}' WHEN 2 THEN '{"messages":[{"role":"assistant","tool_calls":[{"id":1}]}]}' WHEN 3 THEN '{"tool_choice":null}'
  WHEN 4 THEN '{"messages":[{"content":[{"type":"text","text":"x"}]}]}' WHEN 5 THEN '{"messages":[{"content":[{"type":"tool_result"}]}]}' WHEN 6 THEN 'no json' ELSE '{"function_call":"auto"}' END AS body FROM {t}""")


@_query(f"""WITH b AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM ({TOOLS.duck}))
SELECT event_id, coalesce(coalesce(json_type(j, '$.tools') NOT IN ('NULL'), false) OR coalesce(json_type(j, '$.tool_choice') NOT IN ('NULL'), false) OR coalesce(json_type(j, '$.function_call') NOT IN ('NULL'), false)
  OR coalesce(json_type(j, '$.messages[0].tool_calls') NOT IN ('NULL'), false) OR coalesce(json_extract_string(j, '$.messages[0].content[0].type') IN ('tool_use', 'tool_result'), false), false) AS has FROM b""")
def q88_tool_arguments(spark, sf_dir):
    return TOOLS.spark(spark, sf_dir).select("event_id", G.has_tool_arguments(F.col("body")).alias("has"))


NUMBERS = Rows("customer", "SELECT c_custkey, CAST(100000000 + (c_custkey * 7919) % 900000000 AS STRING) AS nine, CAST((c_custkey * 31) % 100 AS STRING) AS two, 1990 + c_custkey % 40 AS year, c_custkey % 14 AS month, (c_custkey * 7) % 33 AS day FROM {t}")


@_query(f"""WITH n AS (SELECT *, nine || lpad(two, 2, '0') AS t FROM ({NUMBERS.duck})), d AS (SELECT *, list_transform(range(1, 12), lambda i: substr(t, i, 1)::INT) AS d FROM n), e AS (SELECT *, ((7 * (d[1] + d[3] + d[5] + d[7] + d[9]) - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 AS tenth FROM d)
SELECT c_custkey, t AS number, d[10] = tenth AND d[11] = (d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + tenth) % 10 AS valid, nine || tenth::VARCHAR || ((d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + tenth) % 10)::VARCHAR AS made FROM e""")
def q89_national_numbers(spark, sf_dir):
    number = F.concat("nine", F.lpad("two", 2, "0"))
    return NUMBERS.spark(spark, sf_dir).select("c_custkey", number.alias("number"), K.tckn_column(number).alias("valid"), F.concat("nine", K.tckn_tail_column(F.col("nine"))).alias("made"))


@_query(f"""WITH n AS (SELECT *, nine || substr(two, 1, 1) AS t FROM ({NUMBERS.duck})), m AS (SELECT *, list_transform(range(1, 10), lambda i: (substr(t, i, 1)::INT + 10 - i) % 10) AS m FROM n),
v AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN m[i] = 9 THEN 9 ELSE (m[i] * (1::BIGINT << (10 - i)::INT)) % 9 END)) AS s FROM m)
SELECT c_custkey, t AS number, substr(t, 10, 1)::INT = (10 - s % 10) % 10 AS valid FROM v""")
def q90_tax_numbers(spark, sf_dir):
    number = F.concat("nine", F.substring("two", 1, 1))
    return NUMBERS.spark(spark, sf_dir).select("c_custkey", number.alias("number"), K.vkn_column(number).alias("valid"))


@_query(f"""WITH n AS ({NUMBERS.duck}) SELECT c_custkey, month BETWEEN 1 AND 12 AND day >= 1 AND day <= CASE WHEN month IN (4, 6, 9, 11) THEN 30 WHEN month = 2 THEN CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END AS real FROM n""")
def q91_real_dates(spark, sf_dir):
    return NUMBERS.spark(spark, sf_dir).select("c_custkey", K.real_date_column(F.col("year"), F.col("month"), F.col("day")).alias("real"))


CARDS = Rows("customer", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '4' || lpad(CAST(c_custkey * 104729 AS STRING), 15, '1') WHEN 1 THEN '34' || lpad(CAST(c_custkey * 104729 AS STRING), 13, '7') WHEN 2 THEN '2720' || lpad(CAST(c_custkey AS STRING), 12, '3')
  WHEN 3 THEN '2721' || lpad(CAST(c_custkey AS STRING), 12, '3') WHEN 4 THEN '36' || lpad(CAST(c_custkey AS STRING), 12, '5') ELSE '9999' || lpad(CAST(c_custkey AS STRING), 12, '0') END AS n FROM {t}""")


@_query(f"""WITH c AS ({CARDS.duck}), l AS (SELECT c_custkey, n, list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN substr(n, i, 1)::INT ELSE (2 * substr(n, i, 1)::INT) // 10 + (2 * substr(n, i, 1)::INT) % 10 END)) % 10 = 0 AS luhn FROM c)
SELECT c_custkey, n, luhn AND c_custkey % 6 IN (0, 1, 2, 4) AS card FROM l""")
def q92_cards(spark, sf_dir):
    return CARDS.spark(spark, sf_dir).select("c_custkey", "n", K.card_column(F.col("n")).alias("card"))


FRAMES = Rows("orders", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'connect' WHEN 1 THEN 'volume' ELSE 'close' END AS kind, o_custkey % 2 AS netns_on, o_custkey AS netns, 1024 + o_orderkey % 60000 AS src_port, 443 AS dst_port, o_orderkey % 250 AS octet, o_orderkey * 3 AS a, o_orderkey % 1000 AS b, o_custkey % 500 AS c, o_orderkey % 17 = 4 AS broken FROM {t}")


def _little(value: F.Column, size: int) -> F.Column:
    """A number's bytes, the lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size))))


@_query(f"""WITH f AS ({FRAMES.duck}) SELECT id, CASE WHEN broken THEN NULL ELSE kind END AS kind, CASE WHEN broken THEN 'length_mismatch' END AS fault, CASE WHEN NOT broken THEN 'tcp' END AS proto, CASE WHEN NOT broken THEN '10.0.0.' || octet::VARCHAR END AS dst_ip,
  CASE WHEN NOT broken THEN src_port END AS src_port, CASE WHEN NOT broken AND netns_on = 1 THEN netns END AS netns, CASE WHEN NOT broken AND kind = 'connect' THEN a END AS t_start_bucket, CASE WHEN NOT broken AND kind = 'connect' THEN c END AS pid,
  CASE WHEN NOT broken AND kind = 'volume' THEN a END AS bytes_out, CASE WHEN NOT broken AND kind = 'close' THEN b END AS duration_ms FROM f""")
def q93_kernel_frames(spark, sf_dir):
    col, number = F.col, F.lit
    pad = lambda n: F.unhex(F.lit("00" * n))
    address = F.concat(F.unhex(F.lit("0A0000")), _little(col("octet"), 1), pad(12))
    key = F.concat(_little(col("netns"), 8), address, address, _little(col("src_port"), 2), _little(col("dst_port"), 2))
    tails = {
        "connect": F.concat(_little(col("a"), 8), _little(col("b"), 8), _little(col("c"), 4), pad(4), pad(8), F.unhex(F.lit("707974686F6E")), pad(10)),
        "volume": F.concat(_little(col("a"), 8), _little(col("b"), 8), _little(col("c"), 8)),
        "close": _little(col("b"), 8),
    }
    tail = F.when(col("kind") == "connect", tails["connect"]).when(col("kind") == "volume", tails["volume"]).otherwise(tails["close"])
    code = F.when(col("kind") == "connect", 1).when(col("kind") == "volume", 2).otherwise(3)
    size = F.when(col("kind") == "connect", 44 + 48).when(col("kind") == "volume", 44 + 24).otherwise(44 + 8)
    flags = F.when(col("netns_on") == 1, B.NETNS).otherwise(0) + F.when(col("kind") == "close", B.DURATION).otherwise(0)
    head = F.concat(_little(code, 1), _little(number(6), 1), _little(flags, 1), _little(number(B.LAYOUT), 1), _little(size, 2), _little(number(0), 2))
    frame = F.concat(head, key, tail, F.when(col("broken"), pad(1)).otherwise(pad(0)))
    read = FRAMES.spark(spark, sf_dir).select("id", B.kernel_frames(frame).alias("f"))
    return read.select("id", *(f"f.{c}" for c in ("kind", "fault", "proto", "dst_ip", "src_port", "netns", "t_start_bucket", "pid", "bytes_out", "duration_ms")))


USES = Rows("events", "SELECT user_id AS session, event_id AS at_id, (event_id * 7919) % 100000 * 10000 AS at_ms, event_id % 7 AS aliases FROM {t}")


@_query(f"""WITH u AS ({USES.duck}), g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY session ORDER BY at_ms, at_id) > 86400000 THEN 1 ELSE 0 END AS fresh FROM u),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY at_ms, at_id ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT session, life::BIGINT AS life, min(at_ms) AS since, max(at_ms) AS last_use, max(at_ms) + 86400000 AS expires, sum(aliases)::BIGINT AS aliases, sum(aliases) > 10000 AS over_ceiling FROM l GROUP BY session, life""")
def q30_ttl_sessions(spark, sf_dir):
    return M.session_lives(USES.spark(spark, sf_dir))


@_query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ner_disabled' WHEN 1 THEN 'dictionary_absent,ner_disabled' ELSE 'ner_disabled,region_too_long' END AS reasons FROM documents""")
def q94_degraded_reasons(spark, sf_dir):
    told = F.array(F.when(F.col("doc_id") % 3 == 1, "dictionary_absent"), F.when(F.col("doc_id") % 3 == 2, "region_too_long"), F.when(F.col("doc_id") % 3 == 2, "region_too_long"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(X.degraded_reasons(told), ",").alias("reasons"))


@_query(r"""WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'vault_unavailable' WHEN 1 THEN 'alias_limit_exceeded' WHEN 2 THEN 'entity_blocked' WHEN 3 THEN 'policy_unloadable' WHEN 4 THEN 'other' END AS refusal FROM events)
SELECT event_id, CASE refusal WHEN 'vault_unavailable' THEN 503 WHEN 'alias_limit_exceeded' THEN 429 WHEN 'entity_blocked' THEN 400 WHEN 'policy_unloadable' THEN 503 END AS status FROM r""")
def q95_refusal_status(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, ["vault_unavailable", "alias_limit_exceeded", "entity_blocked", "policy_unloadable", "other"])), F.when(F.col("event_id") % 6 < 5, (F.col("event_id") % 6 + 1).cast("int")).otherwise(1))
    refusal = F.when(F.col("event_id") % 6 < 5, named)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", G.status(refusal).alias("status"))


WORDS = Rows("events", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PERSON_' || CAST(event_id AS STRING) WHEN 1 THEN 'PERSON_x' WHEN 2 THEN 'ORG_12' WHEN 3 THEN 'plain' ELSE 'LGL_EMAIL_0123456789abcdef' END AS word FROM {t}")


@_query(f"WITH w AS ({WORDS.duck}) SELECT event_id, word, event_id % 5 IN (0, 2, 4) AS shaped FROM w")
def q96_alias_shapes(spark, sf_dir):
    return WORDS.spark(spark, sf_dir).select("event_id", "word", M.is_alias_shaped(F.col("word")).alias("shaped"))


@_query(f"""WITH a AS ({Y.ORACLE['q43_luhn']}), b AS ({ORACLE['q89_national_numbers']}), c AS ({ORACLE['q90_tax_numbers']}), d AS ({Y.ORACLE['q44_iban']})
SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 7 = 5 THEN 'no_check' WHEN c_custkey % 7 = 4 THEN 'unknown' WHEN CASE c_custkey % 7 WHEN 0 THEN luhn WHEN 1 THEN b.valid WHEN 2 THEN c.valid ELSE d.valid END THEN 'valid' ELSE 'invalid' END AS verdict
FROM a JOIN b USING (c_custkey) JOIN c USING (c_custkey) JOIN d USING (c_custkey)""")
def q97_alias_verdicts(spark, sf_dir):
    of = F.col("c_custkey") % 7
    types = F.element_at(F.array(*map(F.lit, ["CREDIT_CARD", "TCKN", "VKN", "IBAN", "PHONE", "EMAIL", None])), (of + 1).cast("int"))
    card = F.lpad((F.col("c_custkey") * 7919 % 1000000007).cast("string"), 12, "4")
    iban = F.concat(F.lit("TR"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 104729).cast("string"), 22, "0"))
    alias = F.when(of == 0, card).when(of == 1, F.concat("nine", F.lpad("two", 2, "0"))).when(of == 2, F.concat("nine", F.substring("two", 1, 1))).when(of == 3, iban).otherwise("x")
    return NUMBERS.spark(spark, sf_dir).select("c_custkey", K.alias_verdict_column(types, alias).alias("verdict"))


#: Lines of an order as frames of a stream: pieces of an alias, and frames without text.
PIECES = Rows(
    "lineitem",
    """SELECT stream, seq, 0 AS now_ms, CASE WHEN seq % 3 = 2 THEN NULL ELSE 'a' END AS lane, CASE seq % 3 WHEN 1 THEN 'PERS' WHEN 2 THEN 'ping' ELSE 'ON_1' END AS text
  FROM (SELECT l_orderkey AS stream, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq FROM {t}) l""",
)


@_query(f"""WITH p AS ({PIECES.duck}), n AS (SELECT stream, count(*) AS n FROM p GROUP BY stream),
-- Each three lines are an alias in two pieces with a frame between them, which goes out after the alias; what is left at the end goes out as it is.
t AS (SELECT stream, n, unnest(range(0, (n + 2) // 3)) AS g FROM n), o AS (
  SELECT stream, 2 * g AS place, 'a' AS lane, CASE WHEN n >= 3 * g + 3 THEN 'Ada' ELSE 'PERS' END AS text FROM t
  UNION ALL SELECT stream, 2 * g + 1, NULL, 'ping' FROM t WHERE n >= 3 * g + 2)
SELECT stream, place, lane, text FROM o""")
def q98_ordered_frames(spark, sf_dir):
    return Z.ordered_frames(PIECES.spark(spark, sf_dir), {"PERSON_1": "Ada"})
