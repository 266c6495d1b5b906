"""The scan report: policy, verdict, coverage, canonical JSON, and the read-side queries over it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASIS_POINTS = 10_000
SEVERITY = ["PASS", "WARN", "FAIL"]
#: Unread reasons that aren't code and so don't count against coverage.
NOT_CODE = ["binary", "skipped_non_code"]
PAGE, LARGEST_PAGE = 20, 100
TRACE_DEPTH, DEEPEST_TRACE = 10, 25
UNREAD_SHOWN = 100
RUNTIME_LANGUAGES = ["csharp", "go", "java", "javascript", "kotlin", "php", "python", "ruby", "rust", "typescript"]


@dataclass(frozen=True)
class Policy:
    """Limits from which findings or unread files raise the verdict; None: no limit."""

    confirmed_fail: int | None = None
    suspect_warn: int | None = 1
    unparsed_warn: int | None = None


def unparsed_ratio(parsed: Column, unread: Column) -> Column:
    """Unread files in basis points of all, rounded up, at most 10,000, 0 of none."""
    total = parsed + unread
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(F.least(F.ceil(unread * BASIS_POINTS / total), F.lit(BASIS_POINTS).cast("long")))


def coverage(files: DataFrame) -> DataFrame:
    """One row from files (path, state, reason): parsed, partial, unread, those that count, and the ratio."""
    one = files.agg(
        F.count_if(F.col("state").isin("parsed", "partial")).alias("parsed_files"),
        F.count_if(F.col("state") == "partial").alias("partial_files"),
        F.count_if(F.col("state") == "unread").alias("unread_files"),
        F.count_if((F.col("state") == "unread") & ~F.col("reason").isin(NOT_CODE)).alias("unread_counting"),
    )
    return one.withColumn("unparsed_ratio_bp", unparsed_ratio(F.col("parsed_files"), F.col("unread_counting")))


def rule_hits(findings: DataFrame, ratio: int, policy: Policy) -> DataFrame:
    """(rule_id, verdict, n, coverage_condition): the three rules of the policy."""
    counts = findings.agg(F.count_if(F.col("confidence") == "confirmed").alias("confirmed"), F.count_if(F.col("confidence") == "suspect").alias("suspect"))
    over = lambda c, limit, bad: F.when(F.col(c) >= limit, bad).otherwise("PASS") if limit is not None else F.lit("PASS")
    limit = policy.unparsed_warn
    said = f"coverage_unparsed_ratio {ratio}" + (", policy declares no limit" if limit is None else f" greater_than {limit}" if ratio > limit else f" within declared limit {limit}")
    rows = F.array(
        F.struct(F.lit("policy.confirmed-egress").alias("rule_id"), over("confirmed", policy.confirmed_fail, "FAIL").alias("verdict"), F.col("confirmed").alias("n"), F.lit(None).cast("string").alias("coverage_condition")),
        F.struct(F.lit("policy.suspect-egress").alias("rule_id"), over("suspect", policy.suspect_warn, "WARN").alias("verdict"), F.col("suspect").alias("n"), F.lit(None).cast("string").alias("coverage_condition")),
        F.struct(F.lit("policy.coverage-unparsed-ratio").alias("rule_id"), F.lit("WARN" if limit is not None and ratio > limit else "PASS").alias("verdict"), F.lit(0).cast("long").alias("n"), F.lit(said).alias("coverage_condition")),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def verdict(hits: DataFrame) -> DataFrame:
    """One row: the worst verdict of the rule hits."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("verdict")).cast("int")
    return hits.agg(F.max(rank).alias("rank")).select(F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce("rank", F.lit(1))).alias("verdict"))


def by_provider(findings: DataFrame) -> DataFrame:
    return findings.groupBy("provider_ref").agg(F.count_if(F.col("confidence") == "confirmed").alias("confirmed"), F.count_if(F.col("confidence") == "suspect").alias("suspect"))


def page(findings: DataFrame, cursor: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of findings by id, with the cursor of the next page, null at the end."""
    limit = max(1, min(limit, LARGEST_PAGE))
    rows = findings.orderBy("finding_id").offset(cursor).limit(limit + 1)
    numbered = rows.withColumn("at", F.row_number().over(Window.orderBy("finding_id")))
    more = numbered.agg(F.count("*").alias("got"))
    following = F.when(F.col("got") > limit, F.lit(cursor + limit)).cast("long")
    return numbered.filter(F.col("at") <= limit).join(F.broadcast(more)).withColumn("next_cursor", following).drop("at", "got")


def detail(findings: DataFrame, finding_id: str) -> DataFrame:
    return findings.filter(F.col("finding_id") == finding_id)


def condensed(findings: DataFrame) -> DataFrame:
    """The short form of findings; place is path:line where there is a location."""
    place = F.concat_ws(":", F.col("location.path"), F.col("location.line").cast("string")) if "location" in findings.columns else F.lit(None).cast("string")
    return findings.select("finding_id", "provider_ref", "confidence", "rule_id", place.alias("place"))


def unread(files: DataFrame) -> DataFrame:
    """The first unread files by path, with how many there are."""
    rows = files.filter("state = 'unread'").select("path", "reason")
    return rows.orderBy("path").limit(UNREAD_SHOWN).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def disagreements(confirmed: DataFrame, suspect: DataFrame) -> DataFrame:
    """One row: findings whose own confidence isn't that of the list they stand in."""
    both = confirmed.select("confidence", F.lit("confirmed").alias("list")).union(suspect.select("confidence", F.lit("suspect").alias("list")))
    return both.agg(F.count_if(F.col("confidence") != F.col("list")).alias("disagreements"))


def unmatched_count(findings: DataFrame) -> DataFrame:
    """One row: unmatched findings; null if any finding lacks its kind."""
    one = findings.agg(F.bool_or(F.col("kind").isNull()).alias("lacking"), F.count_if(F.col("kind") == "unmatched_wire_traffic").alias("n"))
    return one.select(F.when(~F.coalesce("lacking", F.lit(False)), F.col("n")).alias("unmatched"))


def runtime_state(hooks: DataFrame) -> DataFrame:
    """One row from hooks (status): instrumented before degraded before without a hook before unknown."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    every = F.coalesce(F.every(F.col("status") == "no_hook"), F.lit(False))
    return hooks.agg(F.when(has("instrumented"), "instrumented").when(has("degraded"), "degraded").when(every, "no_hook").otherwise("unknown").alias("state"))


def mode(has_events: bool, has_flows: bool) -> str:
    return {(False, False): "static_only", (True, False): "static_runtime", (False, True): "static_wire", (True, True): "full"}[has_events, has_flows]


def join_evidence(evidence: Column) -> Column:
    """struct<join, outcome, fields> of 'Jn:outcome k=v …'; null where the text has another form."""
    shaped = evidence.rlike(r"^J[0-9]+:[a-z_]+")
    tail = F.trim(F.regexp_replace(evidence, r"^J[0-9]+:[a-z_]+", ""))
    fields = F.str_to_map(F.when(tail == "", F.lit(None)).otherwise(tail), F.lit(" "), F.lit("="))
    return F.when(shaped, F.struct(F.regexp_extract(evidence, r"^(J[0-9]+):", 1).alias("join"), F.regexp_extract(evidence, r"^J[0-9]+:([a-z_]+)", 1).alias("outcome"), fields.alias("fields")))


#: What a link of each tier agrees in.
KEY_FIELDS = {"operation_and_target": ["operation", "target"], "operation_only": ["operation"], "target_only": ["target"], "provider_only": ["provider_ref"]}


def key_fields(tier: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in KEY_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), tier)


def trace(findings: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """(finding_id, step, join, outcome, drift, declared, observed, agreed) of each piece of evidence, as deep as asked."""
    pieces = F.slice(F.split("evidence", "; "), 1, max(1, min(depth, DEEPEST_TRACE)))
    steps = findings.select("finding_id", F.posexplode(pieces).alias("step", "text")).withColumn("e", join_evidence(F.col("text")))
    get = lambda k: F.element_at(F.col("e.fields"), k)
    return steps.filter("e is not null").select("finding_id", "step", "e.join", "e.outcome", get("drift").alias("drift"), get("declared").alias("declared"), get("observed").alias("observed"), F.array_join(F.coalesce(key_fields(F.col("e.outcome")), F.array().cast("array<string>")), ",").alias("agreed"))


def discrepancy(findings: DataFrame) -> DataFrame:
    """The first drift of each finding in evidence order, and whether there are several."""
    steps = trace(findings, DEEPEST_TRACE).filter("drift is not null")
    return steps.groupBy("finding_id").agg(F.min(F.struct("step", "drift", "declared", "observed")).alias("d"), F.count_distinct("drift", "declared", "observed").alias("n")).select("finding_id", "d.drift", "d.declared", "d.observed", (F.col("n") > 1).alias("several"))


def sole_ref(refs: Column, kind: str) -> Column:
    """The id of the only reference of a type; null if there are none or several."""
    own = F.filter(refs, lambda r: r["ref_type"] == kind)
    return F.when(F.size(own) == 1, own[0]["ref_id"])


def contributing_sources(refs: Column, stated: Column) -> Column:
    """The sources a finding rests on: those stated, else those of its references' types, sorted."""
    of = F.create_map(F.lit("egress_point"), F.lit("declared"), F.lit("egress_event"), F.lit("observed-app"), F.lit("flow"), F.lit("observed-wire"))
    return F.coalesce(stated, F.array_sort(F.array_distinct(F.filter(F.transform(refs, lambda r: F.element_at(of, r["ref_type"])), lambda x: x.isNotNull()))))


def runtime_coverage(languages: DataFrame) -> DataFrame:
    """(language, status) of languages (language): those seen; all as unsupported if none was."""
    seen = languages.filter("language is not null").select("language").distinct()
    known = languages.sparkSession.createDataFrame([(x,) for x in RUNTIME_LANGUAGES], "language string")
    none = seen.agg((F.count("*") == 0).alias("none"))
    return seen.select("language", F.lit("uninstrumented").alias("status")).union(known.join(F.broadcast(none)).filter("none").select("language", F.lit("unsupported").alias("status")))


def window_fold(windows: DataFrame) -> DataFrame:
    """One row: the shortest observation window; null if any is unmeasured or there is none."""
    return windows.agg(F.when(~F.bool_or(F.col("window_ms").isNull()), F.min("window_ms")).alias("window_ms"))


def platform_class(flows: DataFrame) -> DataFrame:
    """One row: linux_ebpf if every mechanism seen is ebpf, else none."""
    one = flows.agg(F.bool_or(F.col("mechanism").isin("pcap", "etw")).alias("other"), F.bool_or(F.col("mechanism") == "ebpf").alias("ebpf"))
    return one.select(F.when(F.coalesce("other", F.lit(False)), "none").when(F.coalesce("ebpf", F.lit(False)), "linux_ebpf").otherwise("none").alias("platform"))


def scan_id(findings: DataFrame) -> DataFrame:
    """One row: a digest of the sorted finding ids."""
    ids = F.concat_ws(chr(31), F.array_sort(F.collect_set("finding_id")))
    return findings.agg(F.concat(F.lit("scan_"), F.substring(F.sha2(F.concat_ws(chr(31), F.lit("scan/v1"), ids), 256), 1, 16)).alias("scan_id"))


def canonical(report: dict) -> str:
    """The report as JSON with sorted keys, indented, ended by a line feed."""
    return json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def body_hash(report: dict) -> str:
    """A digest of the report without its envelope."""
    return hashlib.sha256(canonical({k: v for k, v in report.items() if k != "envelope"}).encode()).hexdigest()


def build(findings: DataFrame, files: DataFrame | None, policy: Policy, suppressions: list[tuple[str, str]], limit: int = 1000) -> dict:
    """The whole report: verdict, rule hits, counts, coverage, and up to limit findings of each confidence, by id."""
    cover = coverage(files).first().asDict() if files is not None else {"unparsed_ratio_bp": 0}
    hits = rule_hits(findings, cover["unparsed_ratio_bp"], policy)
    take = lambda c: [r.asDict() for r in findings.filter(F.col("confidence") == c).orderBy("finding_id").limit(limit).collect()]
    return {
        "schema_version": "1.4",
        "verdict": verdict(hits).first()[0],
        "policy": {"rule_hits": [r.asDict() for r in hits.collect()]},
        "coverage": cover | {"suppressed": [{"kind": k, "reason": r} for k, r in suppressions]},
        "confirmed": take("confirmed"),
        "suspect": take("suspect"),
        "by_provider": {r.provider_ref: {"confirmed": r.confirmed, "suspect": r.suspect} for r in by_provider(findings).orderBy("provider_ref").collect()},
    }


def summary(report: dict, shown: int = 5) -> str:
    """A few lines for people."""
    unread_files = report["coverage"].get("unread", [])
    lines = [f"verdict {report['verdict']}", f"confirmed {len(report['confirmed'])}, suspect {len(report['suspect'])}"]
    lines += [f"  {f['kind']} {f['primary_ref']} ({f['confidence']})" for f in report["confirmed"][:shown]]
    lines += [f"unread {p}" for p in unread_files[:shown]] + ([f"and {len(unread_files) - shown} more"] if len(unread_files) > shown else [])
    return "\n".join(lines) + "\n"


def sensor_state(mode_name: Column) -> Column:
    """Whether the wire was watched, by reconciliation mode."""
    return F.when(mode_name.isin("static_wire", "full"), "running").when(mode_name.isin("static_only", "static_runtime"), "not_running").otherwise("unknown")


def sensor_status(flows: DataFrame, rejected: DataFrame, unlinked: int, loss_known: bool) -> dict:
    """What a sensor pass saw: flows by scope, rejects by reason, and what it can't tell."""
    scopes = {r.flow_scope: r.n for r in flows.groupBy("flow_scope").agg(F.count("*").alias("n")).collect()}
    reasons = {r.reason: r.n for r in rejected.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    names = ["in_scope", "out_of_scope_process", "known_benign", "undetermined"]
    silent = [] if loss_known else ["lost events were not counted"]
    return {"flows": {n: scopes.get(n, 0) for n in names}, "rejected": reasons, "unlinked_events": unlinked, "not_measured": silent}


def sources_present(run_mode: Column) -> Column:
    """The sources that a mode rests on."""
    return (
        F.when(run_mode == "full", F.array(*map(F.lit, ["declared", "observed-app", "observed-wire"])))
        .when(run_mode == "static_runtime", F.array(F.lit("declared"), F.lit("observed-app")))
        .when(run_mode == "static_wire", F.array(F.lit("declared"), F.lit("observed-wire")))
        .otherwise(F.array(F.lit("declared")))
    )
