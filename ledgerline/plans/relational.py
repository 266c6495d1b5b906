"""Queries over the evidence views, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import targets as T
from ledgerline.operators import derive as D
from ledgerline.operators import episodes as E
from ledgerline.operators import flows as W
from ledgerline.operators import joins as J
from ledgerline.operators import report as R
from ledgerline.operators import validate as V
from ledgerline.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SETTINGS = D.Settings()


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(select: str, *more: str) -> str:
    return f"WITH {', '.join([views.oracle_views(), _CHECKED, *more])} {select}"


_DERIVED = "'ee_' || substr(sha256('ee/v1' || chr(31) || module || chr(31) || operation || chr(31) || host_id || chr(31) || path_template), 1, 16)"
_CHECKED = f"""checked AS (SELECT *, CASE
    WHEN NOT regexp_full_match(egress_event_id, 'ee_[0-9a-f]{{16}}') THEN 'malformed_event_id'
    WHEN NOT regexp_full_match(operation, '[a-z][a-z0-9_.]*') THEN 'malformed_operation'
    WHEN NOT regexp_full_match(provider_ref, '[a-z0-9][a-z0-9-]*') THEN 'malformed_provider_ref'
    WHEN contains(field_path, '=') THEN 'raw_content_in_field_path'
    WHEN regexp_matches(call_site_path, '^([/\\\\]|[A-Za-z]:)') THEN 'absolute_call_site_path'
    WHEN egress_event_id <> {_DERIVED} THEN 'event_id_mismatch' END AS fault FROM raw_event),
event AS (
  SELECT egress_event_id AS ee_id, operation, provider_ref, byte_size_estimate,
    CASE WHEN host_id <> 'unknown' AND NOT target_unresolved THEN host_id END AS obs_host, CASE WHEN host_id <> 'unknown' AND NOT target_unresolved THEN port END AS obs_port,
    CASE WHEN host_id <> 'unknown' THEN host_id END AS wire_host, CASE WHEN host_id <> 'unknown' THEN port END AS wire_port
  FROM (SELECT *, row_number() OVER (PARTITION BY egress_event_id ORDER BY row_no) AS rn FROM checked WHERE fault IS NULL) WHERE rn = 1)"""
_LINK = """pair AS (
  SELECT p.ep_id, e.ee_id, coalesce(p.operation = e.operation, false) AS op, coalesce(p.host = e.obs_host AND p.port IS NOT DISTINCT FROM e.obs_port, false) AS tg,
    coalesce(p.provider_ref = e.provider_ref AND p.provider_ref <> 'unknown', false) AS pr, e.obs_host, e.obs_port
  FROM point p, event e WHERE p.operation = e.operation OR (p.host = e.obs_host AND p.port IS NOT DISTINCT FROM e.obs_port) OR (p.provider_ref = e.provider_ref AND p.provider_ref <> 'unknown')),
link AS (SELECT ep_id, ee_id, CASE WHEN op AND tg THEN 0 WHEN op THEN 1 WHEN tg THEN 2 ELSE 3 END AS tier, obs_host, obs_port FROM pair)"""
_EPISODE = """tgt AS (
  SELECT flow_id, coalesce(resolved_host, dst_ip) AS host, CASE WHEN dst_port NOT IN (80, 443) THEN dst_port END AS port, pid, pid_start_time, flow_scope, process_attribution,
    resolved_host IS NOT NULL AS named, t_start_bucket * 1000 AS s, t_start_bucket * 1000 + duration_ms AS e, bytes_out, provider_ref,
    CASE classification WHEN 'classified' THEN 1 WHEN 'unclassified' THEN 2 ELSE 3 END AS cr FROM flow),
cut AS (SELECT *, CASE WHEN m IS NULL OR s - m > 1000 THEN 1 ELSE 0 END AS fresh FROM (
  SELECT *, max(e) OVER (PARTITION BY host, port, pid, pid_start_time, flow_scope, process_attribution ORDER BY s, e, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tgt)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY host, port, pid, pid_start_time, flow_scope, process_attribution ORDER BY s, e, flow_id) AS ep FROM cut),
episode AS (
  SELECT host, port, pid, pid_start_time, flow_scope, process_attribution, min(flow_id) AS flow_id, min(s) AS start_ms, max(e) AS end_ms, sum(bytes_out)::BIGINT AS bytes_out, count(*) AS flows,
    ['classified', 'unclassified', 'opaque'][max(cr)] AS classification, bool_and(named) AS named, first(provider_ref ORDER BY s, e, flow_id) AS provider_ref
  FROM num GROUP BY host, port, pid, pid_start_time, flow_scope, process_attribution, ep)"""
_CALLS = """calls AS (SELECT wire_host AS host, wire_port AS port, count(*) AS calls, sum(byte_size_estimate) AS bytes, count(*) FILTER (byte_size_estimate = 0) AS unsized FROM event WHERE wire_host IS NOT NULL GROUP BY ALL),
unmatched AS (SELECT * FROM episode WHERE flow_id NOT IN (SELECT flow_id FROM episode x JOIN calls c ON x.host = c.host AND x.port IS NOT DISTINCT FROM c.port))"""
_TARGET = "{h} || CASE WHEN {p} IS NULL THEN '' ELSE ':' || {p}::VARCHAR END"
_OWN, _SEEN = _TARGET.format(h="p.host", p="p.port"), _TARGET.format(h="k.obs_host", p="k.obs_port")
_TIER = "tier AS (SELECT p.*, (SELECT min(tier) FROM link l WHERE l.ep_id = p.ep_id) AS tier FROM point p)"
_DORMANT = """dormant AS (
  SELECT 'dormant_egress_point' AS kind, CASE WHEN host IS NOT NULL AND tier IS NULL AND (SELECT count(*) FROM event WHERE ee_id NOT IN (SELECT ee_id FROM link)) = 0 THEN 'confirmed' ELSE 'suspect' END AS confidence,
    provider_ref, ep_id AS primary_ref, 'J2:' || CASE WHEN tier IS NULL THEN 'none' ELSE 'provider_only' END || ' observation_window_ms=3600000 observed_calls=' || (SELECT count(*) FROM event)::VARCHAR
      || ' unlinked_events=' || (SELECT count(*) FROM event WHERE ee_id NOT IN (SELECT ee_id FROM link))::VARCHAR AS evidence
  FROM tier WHERE tier IS NULL OR tier = 3)"""
_IS_ADDRESS = "(contains({h}, ':') OR regexp_full_match({h}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+'))"
_DRIFT = f"""detail AS (
  SELECT DISTINCT p.ep_id, p.provider_ref, 'J2:operation_only declared=' || {_OWN} || ' observed=' || {_SEEN} || ' drift=' ||
    CASE WHEN {_IS_ADDRESS.format(h='k.obs_host')} AND NOT {_IS_ADDRESS.format(h='p.host')} THEN 'address_literal' WHEN p.host = k.obs_host THEN 'port'
      WHEN ends_with(p.host, '.' || k.obs_host) OR ends_with(k.obs_host, '.' || p.host) THEN 'subdomain' ELSE 'host' END AS d
  FROM point p JOIN event k ON p.operation = k.operation WHERE p.host IS NOT NULL AND k.obs_host IS NOT NULL AND NOT (p.host = k.obs_host AND p.port IS NOT DISTINCT FROM k.obs_port)),
drift AS (SELECT 'target_drift' AS kind, 'confirmed' AS confidence, provider_ref, ep_id AS primary_ref, string_agg(d, '; ' ORDER BY d) AS evidence FROM detail GROUP BY ep_id, provider_ref)"""
_UNMATCHED = f"""open_traffic AS (
  SELECT u.* FROM unmatched u WHERE flow_scope = 'in_scope' AND NOT EXISTS (SELECT 1 FROM point p WHERE p.host = u.host AND p.port IS NOT DISTINCT FROM u.port)
    AND u.provider_ref NOT IN (SELECT provider_ref FROM point WHERE provider_ref <> 'unknown')),
unreadable AS (SELECT count(DISTINCT ee_id) AS n FROM event WHERE wire_host IS NULL),
unexplained AS (
  SELECT 'unmatched_wire_traffic' AS kind, CASE WHEN named AND n = 0 THEN 'confirmed' ELSE 'suspect' END AS confidence, provider_ref, flow_id AS primary_ref,
    'J1:none J3:none flow_scope=' || flow_scope || ' target=' || {_TARGET.format(h='host', p='port')} || ' provider=' || provider_ref || ' classification=' || classification || ' attribution=' || process_attribution
      || ' flows=' || flows::VARCHAR || ' span_ms=' || (end_ms - start_ms)::VARCHAR || ' bytes_out=' || coalesce(bytes_out::VARCHAR, 'not_counted') || ' tolerance_ms=1000 runtime_source=present unreadable_call_targets=' || n::VARCHAR AS evidence
  FROM open_traffic, unreadable)"""
_VOLUME = f"""expected AS (
  SELECT flow_id, sum(calls)::BIGINT AS calls, sum(bytes)::BIGINT AS expected, sum(unsized) AS unsized FROM (SELECT DISTINCT flow_id, host, port FROM episode) x JOIN calls c ON x.host = c.host AND x.port IS NOT DISTINCT FROM c.port GROUP BY flow_id),
volume AS (
  SELECT 'volume_anomaly' AS kind, CASE WHEN calls = 1 AND named AND process_attribution = 'kernel_attributed' THEN 'confirmed' ELSE 'suspect' END AS confidence, provider_ref, flow_id AS primary_ref,
    'J1:' || CASE WHEN calls = 1 AND named AND process_attribution = 'kernel_attributed' THEN 'exact' ELSE 'ambiguous' END || ' target=' || {_TARGET.format(h='host', p='port')} || ' expected_bytes=' || expected::VARCHAR || ' observed_bytes=' || bytes_out::VARCHAR
      || ' band_bytes=' || lo::VARCHAR || '..' || hi::VARCHAR || ' band_basis_points=5000..30000 flows=' || flows::VARCHAR || ' calls=' || calls::VARCHAR AS evidence
  FROM (SELECT *, expected * 5000 // 10000 AS lo, (expected * 30000 + 9999) // 10000 AS hi FROM episode JOIN expected USING (flow_id) WHERE flow_scope = 'in_scope' AND bytes_out IS NOT NULL AND calls > 0 AND unsized = 0)
  WHERE bytes_out < lo OR bytes_out > hi)"""
_FINDINGS = """finding AS (
  SELECT 'fnd_' || substr(sha256('fi/v1' || chr(31) || kind || chr(31) || 'reconciled' || chr(31) || primary_ref || chr(31) || rule_id), 1, 16) AS finding_id, kind, min(confidence) AS confidence, min(provider_ref) AS provider_ref, primary_ref, rule_id, min(evidence) AS evidence
  FROM (SELECT *, 'reconcile.' || replace(kind, '_', '-') AS rule_id FROM (SELECT * FROM dormant UNION ALL SELECT * FROM drift UNION ALL SELECT * FROM unexplained UNION ALL SELECT * FROM volume)) GROUP BY kind, primary_ref, rule_id)"""
_ALL = [_LINK, _TIER, _EPISODE, _CALLS, _DORMANT, _DRIFT, _UNMATCHED, _VOLUME, _FINDINGS]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.observed_events(V.valid_events(views.events(spark, sf_dir)))


@_query(_with("SELECT row_no, egress_event_id FROM checked WHERE fault IS NULL"))
def q01_valid_events(spark, sf_dir):
    return V.checked_events(views.events(spark, sf_dir)).filter("fault is null").select("row_no", "egress_event_id")


@_query(_with("SELECT fault, count(*) AS n FROM checked WHERE fault IS NOT NULL GROUP BY fault"))
def q02_reject_counts(spark, sf_dir):
    return V.tally(V.checked_events(views.events(spark, sf_dir)), "fault")


@_query(_with("SELECT ee_id, operation AS ee_operation, obs_host, obs_port, wire_host, wire_port FROM event"))
def q03_event_dedup(spark, sf_dir):
    return _events(spark, sf_dir).select("ee_id", "ee_operation", "obs_host", "obs_port", "wire_host", "wire_port")


_HOSTS = """host AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'API.OpenAI.com' WHEN 1 THEN 'eu.openai.azure.com' WHEN 2 THEN 'bedrock-runtime.eu-west-1.amazonaws.com' WHEN 3 THEN 'europe-aiplatform.googleapis.com'
  WHEN 4 THEN 'bedrock.x.amazonaws.com.evil.test' WHEN 5 THEN 'openrouter.ai' ELSE regexp_extract(url, '://([^/?#]*)', 1) END AS host FROM pages)"""


@_query(f"""WITH {_HOSTS} SELECT page_id, host, CASE WHEN lower(host) = 'api.openai.com' THEN 'openai' WHEN lower(host) = 'openrouter.ai' THEN 'openrouter' WHEN ends_with(host, '.openai.azure.com') THEN 'azure-openai'
  WHEN ends_with(host, '-aiplatform.googleapis.com') THEN 'google-vertex' WHEN regexp_full_match(host, 'bedrock(-runtime)?\\.[a-z0-9-]+\\.amazonaws\\.com') THEN 'aws-bedrock' ELSE 'unknown' END AS provider_ref FROM host""")
def q04_provider_classify(spark, sf_dir):
    made = {0: "API.OpenAI.com", 1: "eu.openai.azure.com", 2: "bedrock-runtime.eu-west-1.amazonaws.com", 3: "europe-aiplatform.googleapis.com", 4: "bedrock.x.amazonaws.com.evil.test", 5: "openrouter.ai"}
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    for k, v in made.items():
        host = F.when(F.col("page_id") % 12 == k, v).otherwise(host)
    return T.classify_hosts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host")), "host")


@_query(r"""SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') OR regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-')
  OR regexp_full_match(s, '[0-9a-fA-F]{16,}') OR regexp_full_match(s, '[A-Za-z0-9_-]{20,}') OR (regexp_full_match(s, '[A-Za-z]+[-_][A-Za-z0-9]{8,}') AND regexp_matches(regexp_extract(s, '^[A-Za-z]+[-_](.*)$', 1), '[0-9]')) THEN '{id}' ELSE s END), '/') AS template FROM pages""")
def q05_path_template(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.path_template(path).alias("template"))


@_query(r"""WITH t AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN ' HTTPS://User@Host.Example.COM.:8443/x?y ' WHEN 1 THEN '[2001:DB8::1]:8080' WHEN 2 THEN '2001:db8::2' WHEN 3 THEN 'host:99999' WHEN 4 THEN 'https://' WHEN 5 THEN regexp_extract(url, '://([^/?#]*)', 1) || ':443' ELSE url END AS text, url FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'host.example.com' WHEN 1 THEN '2001:db8::1' WHEN 2 THEN '2001:db8::2' WHEN 3 THEN 'host:99999' WHEN 4 THEN NULL ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS host, CASE page_id % 7 WHEN 0 THEN 8443 WHEN 1 THEN 8080 END AS port FROM t""")
def q06_target_parse(spark, sf_dir):
    made = {0: " HTTPS://User@Host.Example.COM.:8443/x?y ", 1: "[2001:DB8::1]:8080", 2: "2001:db8::2", 3: "host:99999", 4: "https://"}
    text = F.when(F.col("page_id") % 7 == 5, F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(":443"))).otherwise(F.col("url"))
    for k, v in made.items():
        text = F.when(F.col("page_id") % 7 == k, v).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("t", T.parse_target(text)).select("page_id", "t.host", "t.port")


@_query(_with("SELECT ep_id, ee_id, tier, obs_host, obs_port FROM link", _LINK))
def q07_j2_links(spark, sf_dir):
    return J.links(views.points(spark, sf_dir), _events(spark, sf_dir))


@_query(_with("SELECT ee_id FROM event WHERE ee_id NOT IN (SELECT ee_id FROM link)", _LINK))
def q08_unlinked_events(spark, sf_dir):
    return J.unlinked_events(views.points(spark, sf_dir), _events(spark, sf_dir))


@_query(_with("SELECT ep_id, tier FROM tier", _LINK, _TIER))
def q09_point_tiers(spark, sf_dir):
    return J.point_tiers(views.points(spark, sf_dir), _events(spark, sf_dir)).select("ep_id", "tier")


@_query(_with("SELECT count(*) FILTER (flow_scope = 'in_scope') AS in_scope, count(*) FILTER (flow_scope = 'out_of_scope_process') AS out_of_scope, count(*) FILTER (flow_scope = 'known_benign') AS known_benign, count(*) FILTER (flow_scope = 'undetermined') AS undetermined, count(*) FILTER (classification <> 'classified') AS unclassified FROM flow"))
def q10_flow_buckets(spark, sf_dir):
    return E.bucket_counts(views.flows(spark, sf_dir))


@_query(_with("SELECT CASE WHEN process_attribution = 'unattributed' THEN 'undetermined' WHEN coalesce(resolved_host IN ('h3.example', 'h7.example'), false) THEN 'known_benign' WHEN comm IN ('python', 'node') THEN 'in_scope' ELSE 'out_of_scope_process' END AS scope, count(*) AS n FROM flow GROUP BY 1"))
def q11_scope(spark, sf_dir):
    own = V.scope(F.col("process_attribution"), F.lit(None).cast("string"), F.col("comm"), F.col("resolved_host"), ["python", "node"], ["h3.example", "h7.example"])
    return views.flows(spark, sf_dir).groupBy(own.alias("scope")).agg(F.count("*").alias("n"))


@_query(_with("SELECT host, port, pid, pid_start_time, flow_scope, process_attribution, flow_id, start_ms, end_ms, bytes_out, flows, classification, named, provider_ref FROM episode", _EPISODE))
def q12_episodes(spark, sf_dir):
    return E.episodes(views.flows(spark, sf_dir))


@_query(_with("SELECT x.flow_id, e.ee_id, CASE WHEN c.calls = 1 AND x.named AND x.process_attribution = 'kernel_attributed' THEN 'exact' ELSE 'ambiguous' END AS quality FROM episode x JOIN calls c ON x.host = c.host AND x.port IS NOT DISTINCT FROM c.port JOIN event e ON e.wire_host = x.host AND e.wire_port IS NOT DISTINCT FROM x.port", _EPISODE, _CALLS))
def q13_j1_links(spark, sf_dir):
    return J.wire_links(E.episodes(views.flows(spark, sf_dir)), _events(spark, sf_dir))


@_query(_with("SELECT flow_id, host, port FROM unmatched", _EPISODE, _CALLS))
def q14_unmatched_episodes(spark, sf_dir):
    return J.unmatched_episodes(E.episodes(views.flows(spark, sf_dir)), _events(spark, sf_dir)).select("flow_id", "host", "port")


@_query(_with("SELECT * FROM dormant", _LINK, _TIER, _DORMANT))
def q15_dormant(spark, sf_dir):
    return D.dormant(views.points(spark, sf_dir), _events(spark, sf_dir), SETTINGS)


@_query(_with("SELECT * FROM drift", _DRIFT))
def q16_drift(spark, sf_dir):
    return D.drift(views.points(spark, sf_dir), _events(spark, sf_dir))


@_query(_with("SELECT * FROM unexplained", _EPISODE, _CALLS, _UNMATCHED))
def q17_unmatched(spark, sf_dir):
    return D.unmatched(views.points(spark, sf_dir), _events(spark, sf_dir), views.flows(spark, sf_dir), SETTINGS)


@_query(_with("SELECT * FROM volume", _EPISODE, _CALLS, _VOLUME))
def q18_volume(spark, sf_dir):
    return D.volume(_events(spark, sf_dir), views.flows(spark, sf_dir), SETTINGS)


@_query("""SELECT * FROM (VALUES ('no_events', 'dormant_egress_point', 'runtime_source_absent'), ('no_events', 'target_drift', 'runtime_source_absent'), ('no_events', 'volume_anomaly', 'runtime_source_absent'),
  ('no_flows', 'unmatched_wire_traffic', 'wire_source_absent'), ('no_flows', 'volume_anomaly', 'wire_source_absent'), ('short', 'dormant_egress_point', 'observation_window_too_short'), ('no_band', 'volume_anomaly', 'volume_band_not_declared'),
  ('no_points', 'dormant_egress_point', 'declared_source_absent'), ('no_points', 'target_drift', 'declared_source_absent'), ('no_points', 'unmatched_wire_traffic', 'declared_source_absent'), ('no_points', 'volume_anomaly', 'declared_source_absent'),
  ('unmeasured', 'volume_anomaly', 'volume_not_measured')) t(run, kind, reason)""")
def q19_suppression(spark, sf_dir):
    seen = views.flows(spark, sf_dir).agg(F.count("*").alias("n"), F.count("bytes_out").alias("c")).first()
    measured = None if not seen.n else seen.c > 0
    runs = {
        "full": D.suppressed(True, True, True, measured, SETTINGS),
        "no_events": D.suppressed(True, False, True, measured, SETTINGS),
        "no_flows": D.suppressed(True, True, False, None, SETTINGS),
        "no_points": D.suppressed(False, True, True, measured, SETTINGS),
        "short": D.suppressed(True, True, True, measured, D.Settings(window_ms=60_000)),
        "no_band": D.suppressed(True, True, True, measured, D.Settings(band=None)),
        "unmeasured": D.suppressed(True, True, True, False, SETTINGS),
    }
    return spark.createDataFrame([(run, k, r) for run, own in runs.items() for k, r in own], "run string, kind string, reason string")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.findings(views.points(spark, sf_dir), _events(spark, sf_dir), views.flows(spark, sf_dir), SETTINGS)[0]


@_query(_with("SELECT * FROM finding", *_ALL))
def q20_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


_HITS = """hits AS (
  SELECT 'policy.confirmed-egress' AS rule_id, CASE WHEN count(*) FILTER (confidence = 'confirmed') >= 1 THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) FILTER (confidence = 'confirmed') AS n, NULL AS coverage_condition FROM finding
  UNION ALL SELECT 'policy.suspect-egress', CASE WHEN count(*) FILTER (confidence = 'suspect') >= 1 THEN 'WARN' ELSE 'PASS' END, count(*) FILTER (confidence = 'suspect'), NULL FROM finding
  UNION ALL SELECT 'policy.coverage-unparsed-ratio', 'WARN', 0, 'coverage_unparsed_ratio 1200 greater_than 500')"""
POLICY = R.Policy(confirmed_fail=1, suspect_warn=1, unparsed_warn=500)


@_query(_with("SELECT * FROM hits", *_ALL, _HITS))
def q21_policy_hits(spark, sf_dir):
    return R.rule_hits(_findings(spark, sf_dir), 1200, POLICY)


@_query(_with("SELECT CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict FROM hits", *_ALL, _HITS))
def q22_verdict(spark, sf_dir):
    return R.verdict(R.rule_hits(_findings(spark, sf_dir), 1200, POLICY))


@_query(_with("SELECT provider_ref, count(*) FILTER (confidence = 'confirmed') AS confirmed, count(*) FILTER (confidence = 'suspect') AS suspect FROM finding GROUP BY provider_ref", *_ALL))
def q23_by_provider(spark, sf_dir):
    return R.by_provider(_findings(spark, sf_dir))


@_query(_with("SELECT *, CASE WHEN (SELECT count(*) FROM finding) > 60 THEN 60 END::BIGINT AS next_cursor FROM (SELECT * FROM finding ORDER BY finding_id LIMIT 20 OFFSET 40)", *_ALL))
def q24_findings_page(spark, sf_dir):
    return R.page(_findings(spark, sf_dir), cursor=40, limit=20)


@_query(_with("""SELECT finding_id, (step - 1)::INT AS step, regexp_extract(t, '^(J[0-9]+):', 1) AS "join", regexp_extract(t, '^J[0-9]+:([a-z_]+)', 1) AS outcome, nullif(regexp_extract(t, ' drift=([^ ]*)', 1), '') AS drift,
  nullif(regexp_extract(t, ' declared=([^ ]*)', 1), '') AS declared, nullif(regexp_extract(t, ' observed=([^ ]*)', 1), '') AS observed,
  CASE regexp_extract(t, '^J[0-9]+:([a-z_]+)', 1) WHEN 'operation_only' THEN 'operation' WHEN 'provider_only' THEN 'provider_ref' ELSE '' END AS agreed
  FROM (SELECT finding_id, unnest(string_split(evidence, '; ')) AS t, generate_subscripts(string_split(evidence, '; '), 1) AS step FROM finding) WHERE step <= 10""", *_ALL))
def q25_trace(spark, sf_dir):
    return R.trace(_findings(spark, sf_dir))


@_query(_with("SELECT CASE WHEN p.own THEN 'target' ELSE 'provider' END AS reason, count(*) AS episodes, sum(flows)::BIGINT AS flows FROM (SELECT u.*, EXISTS (SELECT 1 FROM point p WHERE p.host = u.host AND p.port IS NOT DISTINCT FROM u.port) AS own, u.provider_ref IN (SELECT provider_ref FROM point WHERE provider_ref <> 'unknown') AS prov FROM unmatched u WHERE flow_scope = 'in_scope') p WHERE own OR prov GROUP BY 1", _EPISODE, _CALLS))
def q26_silences(spark, sf_dir):
    return D.silences(views.points(spark, sf_dir), _events(spark, sf_dir), views.flows(spark, sf_dir), SETTINGS)


@_query(_with("SELECT DISTINCT p.ep_id, e.obs_host AS host, e.obs_port AS port FROM point p JOIN event e ON p.operation = e.operation WHERE p.host IS NULL AND e.obs_host IS NOT NULL"))
def q27_resolved_targets(spark, sf_dir):
    return D.resolved_targets(views.points(spark, sf_dir), _events(spark, sf_dir))


@_query("""WITH k AS (SELECT event_id, user_id AS key, floor(epoch(ts))::BIGINT AS tick, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'click' THEN 'volume' WHEN 'view' THEN 'volume' WHEN 'purchase' THEN 'close' ELSE 'connect' END AS kind, event_id % 1000 AS bytes FROM events),
o AS (SELECT *, coalesce(sum(CASE WHEN kind = 'close' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inc FROM k),
p AS (SELECT *, max(CASE WHEN kind = 'connect' THEN 1 ELSE 0 END) OVER (PARTITION BY key, inc ORDER BY tick, event_id) AS live FROM o)
SELECT key, inc::BIGINT AS incarnation, max(tick) FILTER (kind = 'connect') AS connected_at, count(*) FILTER (kind = 'volume' AND live = 1) AS volumes, coalesce(sum(bytes) FILTER (kind = 'volume' AND live = 1), 0)::BIGINT AS bytes, bool_or(kind = 'close' AND live = 1) AS closed,
  count(*) FILTER (kind <> 'connect' AND live = 0) AS orphans FROM p GROUP BY key, inc""")
def q32_assemble_flows(spark, sf_dir):
    return W.assembled(kernel_events(spark, sf_dir))


def kernel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel events (key, at, event_id, kind, bytes)."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {"signup": "connect", "click": "volume", "view": "volume", "purchase": "close", "error": "connect"}.items() for x in kv)), F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("at"), "event_id", kind.alias("kind"), (F.col("event_id") % 1000).alias("bytes"))


@_query("""WITH n AS (SELECT value AS v, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events),
w AS (SELECT v FROM n WHERE r <= 1024) SELECT quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, count(*) AS n FROM w""")
def q31_latency_quantiles(spark, sf_dir):
    return W.latency(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("ms"), "ts", "event_id"))


def dns_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows (flow_id, dst_ip, at) and answers (ip, name, at, ttl)."""
    flows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("flow_id"), F.concat(F.lit("ip"), (F.col("o_custkey") % 50).cast("string")).alias("dst_ip"), ((F.col("o_orderkey") * 7919) % 20000).alias("at"))
    answers = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("ip"), (F.col("event_id") % 50).cast("string")).alias("ip"), F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")).alias("name"), ((F.col("event_id") * 31) % 20000).alias("at"), ((F.col("event_id") % 5) * 1000).alias("ttl"))
    return flows, answers


@_query("""WITH f AS (SELECT o_orderkey AS flow_id, 'ip' || (o_custkey % 50)::VARCHAR AS ip, (o_orderkey * 7919) % 20000 AS tick FROM orders),
a AS (SELECT 'ip' || (event_id % 50)::VARCHAR AS ip, 'n' || (user_id % 40)::VARCHAR AS name, (event_id * 31) % 20000 AS tick, (event_id % 5) * 1000 AS ttl FROM events),
s AS (SELECT ip, name, tick AS since, tick + least(greatest(ttl, 30), 3600) AS until FROM a)
SELECT f.flow_id, coalesce(array_to_string(list_sort(list_distinct(list(s.name) FILTER (s.name IS NOT NULL))), ','), '') AS names FROM f LEFT JOIN s ON f.ip = s.ip AND s.since <= f.tick AND f.tick < s.until GROUP BY f.flow_id""")
def q34_dns_names(spark, sf_dir):
    return J.named_at(*dns_tables(spark, sf_dir)).select("flow_id", F.array_join("dns_names", ",").alias("names"))
