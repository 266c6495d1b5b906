"""Record validation: the first rule that a record breaks, and tallies of the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import identity as I
from ledgerline.functions import targets as T

OPERATION = r"^[a-z][a-z0-9_.]*$"
PROVIDER = r"^[a-z0-9][a-z0-9-]*$"
VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+$"


def event_fault(event_id: Column, operation: Column, provider: Column, field_paths: Column, call_site: Column, derived_id: Column) -> Column:
    """The first rule that an event breaks, null if none."""
    return (
        F.when(~I.is_identity("ee_", event_id), "malformed_event_id")
        .when(~operation.rlike(OPERATION), "malformed_operation")
        .when(provider.isNotNull() & ~provider.rlike(PROVIDER), "malformed_provider_ref")
        .when(F.exists(field_paths, lambda p: p.contains("=")), "raw_content_in_field_path")
        .when(F.coalesce(T.is_absolute_path(call_site), F.lit(False)), "absolute_call_site_path")
        .when(event_id != derived_id, "event_id_mismatch")
    )


def checked_events(events: DataFrame) -> DataFrame:
    """events with fault, the first rule broken."""
    derived = I.event_identity(F.col("module"), F.col("operation"), F.col("host_id"), F.col("path_template"))
    fault = event_fault(F.col("egress_event_id"), F.col("operation"), F.col("provider_ref"), F.array("field_path"), F.col("call_site_path"), derived)
    return events.withColumn("fault", fault)


def valid_events(events: DataFrame) -> DataFrame:
    """Valid events, the first row of each id in row order; rows of an id are reduced to one before they are sent."""
    ok = checked_events(events).filter("fault is null").drop("fault")
    first = F.min_by(F.struct(*(f"`{c}`" for c in ok.columns)), "row_no").alias("first")
    return ok.groupBy("egress_event_id").agg(first).select("first.*")


def flow_fault(flow: DataFrame) -> Column:
    """The first rule that a flow record breaks, null if none. Absent columns count as null."""
    has = lambda name, kind="string": F.col(name) if name.split(".")[0] in flow.columns else F.lit(None).cast(kind)
    provider, host, source = has("provider_ref"), has("resolved_host"), has("resolved_host_source")
    kind = has("classification")
    named = provider.isNotNull() & (provider != T.UNKNOWN)
    agrees = F.when(kind == "classified", named).when(kind == "unclassified", ~named & host.isNotNull()).when(kind == "opaque", ~named & host.isNull()).otherwise(False)
    detailed = has("provider_confidence").isNotNull() | has("ruleset_version").isNotNull()
    attributed = has("process_attribution").isin("kernel_attributed", "inferred")
    process = has("process").isNotNull() if "process" in flow.columns else has("pid", "long").isNotNull()
    exe = has("process.exe") if "process" in flow.columns else has("exe")
    return (
        F.when(~I.is_identity("fl_", has("flow_id")), "malformed_flow_id")
        .when(provider.isNotNull() & ~provider.rlike(PROVIDER), "malformed_provider_ref")
        .when(has("sni").isNotNull() & (F.coalesce(has("sni_source"), F.lit("absent")) != "client_hello"), "sni_without_client_hello")
        .when(~F.coalesce(agrees, F.lit(False)), "classification_without_its_witness")
        .when(detailed & (kind != "classified"), "classification_detail_without_classification")
        .when(has("ruleset_version").isNotNull() & ~has("ruleset_version").rlike(VERSION), "malformed_ruleset_version")
        .when(F.coalesce(attributed, F.lit(False)) != process, "attribution_disagrees_with_process")
        .when(host.isNotNull() != F.coalesce(source != "none", F.lit(False)), "resolved_host_source_disagrees")
        .when(F.coalesce(exe.rlike(r"[/\\]"), F.lit(False)), "path_in_record_body")
    )


def tally(rows: DataFrame, reason: str) -> DataFrame:
    """How many rows each reason rejected."""
    return rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def classification(provider: Column, host: Column) -> Column:
    return F.when(provider.isNotNull() & (provider != T.UNKNOWN), "classified").when(host.isNotNull(), "unclassified").otherwise("opaque")


def scope(attribution: Column, exe: Column, comm: Column, host: Column, ours: list[str], benign: list[str]) -> Column:
    """Whose traffic a flow is: undetermined without a process, benign by host, in scope by program name."""
    key = F.coalesce(exe, comm)
    return (
        F.when((attribution == "unattributed") | key.isNull(), "undetermined")
        .when(F.coalesce(host.isin(benign), F.lit(False)) if benign else F.lit(False), "known_benign")
        .when(key.isin(ours) if ours else F.lit(False), "in_scope")
        .otherwise("out_of_scope_process")
    )
