"""Derivations: dormant points, drifted targets, unexplained traffic, volume anomalies; and what a run can't support.

A source that is absent is None, never an empty table; which derivations may run is decided on the driver
from one small row, and those that may not are never planned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import identity as I
from ledgerline.functions import targets as T
from ledgerline.functions.tables import settle
from ledgerline.operators import episodes as E
from ledgerline.operators import joins as J

KINDS = ["dormant_egress_point", "target_drift", "unmatched_wire_traffic", "volume_anomaly"]
#: The observation window below which silence says nothing.
LEAST_WINDOW_MS = 600_000
RULES = {k: f"reconcile.{k.replace('_', '-')}" for k in KINDS}


@dataclass(frozen=True)
class Settings:
    """window_ms: how long calls were observed; band: least and most observed bytes, in basis points of those expected."""

    window_ms: int = 3_600_000
    band: tuple[int, int] | None = (5_000, 30_000)
    join_tolerance_ms: int = 250

    def __post_init__(self) -> None:
        if self.band and self.band[0] > self.band[1]:
            raise ValueError("the band is inverted")


def suppressed(has_points: bool, has_events: bool, has_flows: bool, flows_measured: bool | None, settings: Settings) -> list[tuple[str, str]]:
    """(kind, reason) of the derivations that the run can't support. flows_measured: None without flows, else whether any counts bytes."""
    out = set()
    dormant, drift, unmatched, volume = KINDS
    if not has_points:
        out |= {(k, "declared_source_absent") for k in KINDS}
    if not has_events:
        out |= {(k, "runtime_source_absent") for k in (dormant, drift, volume)}
    if not has_flows:
        out |= {(k, "wire_source_absent") for k in (unmatched, volume)}
    if settings.window_ms < LEAST_WINDOW_MS:
        out.add((dormant, "observation_window_too_short"))
    if settings.band is None:
        out.add((volume, "volume_band_not_declared"))
    if flows_measured is False:
        out.add((volume, "volume_not_measured"))
    return sorted(out)


def dormant(points: DataFrame, events: DataFrame, settings: Settings) -> DataFrame:
    """Points that no call is attributed to."""
    unlinked = J.unlinked_events(points, events).agg(F.count("*").alias("unlinked"))
    calls = events.agg(F.count("*").alias("calls"))
    quiet = J.point_tiers(points, events).filter("tier is null or tier > 2").join(F.broadcast(unlinked)).join(F.broadcast(calls))
    rung = F.when(F.col("tier").isNull(), "none").otherwise("provider_only")
    sure = F.col("host").isNotNull() & (F.col("unlinked") == 0) & F.col("tier").isNull()
    evidence = F.concat(F.lit("J2:"), rung, F.lit(f" observation_window_ms={settings.window_ms} observed_calls="), F.col("calls").cast("string"), F.lit(" unlinked_events="), F.col("unlinked").cast("string"))
    return quiet.select(F.lit(KINDS[0]).alias("kind"), F.when(sure, "confirmed").otherwise("suspect").alias("confidence"), "provider_ref", F.col("ep_id").alias("primary_ref"), evidence.alias("evidence"))


def drift(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points whose operation was called at another target: one finding per point, its details sorted and distinct.

    Events are first reduced to their distinct operations and targets, so the join meets keys, not calls.
    """
    seen = events.filter("obs_host is not null").groupBy("ee_operation", "obs_host", "obs_port").agg(F.count("*").alias("calls"))
    same = (F.col("host") == F.col("obs_host")) & F.col("port").eqNullSafe(F.col("obs_port"))
    met = points.filter("host is not null").join(seen, F.col("operation") == F.col("ee_operation")).filter(~same)
    detail = F.concat(
        F.lit("J2:operation_only declared="), T.target_text(F.col("host"), F.col("port")), F.lit(" observed="), T.target_text(F.col("obs_host"), F.col("obs_port")),
        F.lit(" drift="), T.drift_kind(F.col("host"), F.col("port"), F.col("obs_host"), F.col("obs_port")),
    )
    one = met.groupBy("ep_id", "provider_ref").agg(F.array_sort(F.collect_set(detail)).alias("details"), F.sum("calls").alias("calls"))
    return one.select(F.lit(KINDS[1]).alias("kind"), F.lit("confirmed").alias("confidence"), "provider_ref", F.col("ep_id").alias("primary_ref"), F.array_join("details", "; ").alias("evidence"))


def drift_details(points: DataFrame, events: DataFrame) -> DataFrame:
    """(ep_id, details, calls): how many distinct drifted targets and calls a point has."""
    found = drift(points, events)
    return found.select(F.col("primary_ref").alias("ep_id"), F.size(F.split("evidence", "; ")).cast("long").alias("details"), F.md5("evidence").alias("evidence_md5"))


def resolved_targets(points: DataFrame, events: DataFrame) -> DataFrame:
    """(ep_id, host, port): targets of calls that reached points without a declared target."""
    seen = events.filter("obs_host is not null").select("ee_operation", "obs_host", "obs_port").distinct()
    met = points.filter("host is null").join(seen, F.col("operation") == F.col("ee_operation"))
    return met.select("ep_id", F.col("obs_host").alias("host"), F.col("obs_port").alias("port")).distinct()


def unmatched(points: DataFrame, events: DataFrame | None, flows: DataFrame, settings: Settings, episodes: DataFrame | None = None) -> DataFrame:
    """In-scope episodes that neither a call nor the code accounts for; episodes are those of flows, where they are known already."""
    found = (E.episodes(flows, settings.join_tolerance_ms) if episodes is None else episodes).filter("flow_scope = 'in_scope'")
    if events is not None:
        found = J.unmatched_episodes(found, events).join(F.broadcast(J.unreadable_events(events)))
    else:
        found = found.withColumn("unreadable", F.lit(0).cast("long"))
    found = J.explained(found, points).filter("silenced is null")
    watched = events is not None
    sure = F.lit(watched) & F.col("named") & (F.col("unreadable") == 0)
    parts = [
        ("J1:none J3:none flow_scope=", F.col("flow_scope")),
        (" target=", T.target_text(F.col("host"), F.col("port"))),
        (" provider=", F.col("provider_ref")),
        (" classification=", F.col("classification")),
        (" attribution=", F.col("process_attribution")),
        (" flows=", F.col("flows").cast("string")),
        (" span_ms=", (F.col("end_ms") - F.col("start_ms")).cast("string")),
        (" bytes_out=", F.coalesce(F.col("bytes_out").cast("string"), F.lit("not_counted"))),
        (f" tolerance_ms={E.tolerance(settings.join_tolerance_ms)} runtime_source={'present' if watched else 'absent'} unreadable_call_targets=", F.col("unreadable").cast("string")),
    ]
    evidence = F.concat(*(c for text, col in parts for c in (F.lit(text), col)))
    return found.select(F.lit(KINDS[2]).alias("kind"), F.when(sure, "confirmed").otherwise("suspect").alias("confidence"), "provider_ref", F.col("flow_id").alias("primary_ref"), evidence.alias("evidence"))


def band(expected, basis_points: int, up: bool):
    """A bound of the band in whole bytes: the least rounded down, the most rounded up."""
    product = expected.cast("decimal(28,0)") * F.lit(basis_points).cast("decimal(10,0)")
    return F.call_function("ceil" if up else "floor", product / F.lit(10_000).cast("decimal(10,0)")).cast("long")


def volume(events: DataFrame, flows: DataFrame, settings: Settings, episodes: DataFrame | None = None) -> DataFrame:
    """In-scope episodes whose bytes lie outside the band around what their calls declared.

    Candidates are looked up by flow id, so conversations that share one share their calls.
    """
    low, high = settings.band
    every = (E.episodes(flows, settings.join_tolerance_ms) if episodes is None else episodes).withColumn("key", F.coalesce("port", F.lit(-1)))
    sums = every.select("flow_id", "host", "key").distinct().join(J.event_targets(events), ["host", "key"]).groupBy("flow_id").agg(F.sum("calls").alias("calls"), F.sum("bytes").alias("expected"), F.sum("unsized").alias("unsized"))
    met = every.filter("flow_scope = 'in_scope' and bytes_out is not null").join(sums, "flow_id").filter("calls > 0 and unsized = 0")
    least, most = band(F.col("expected"), low, False), band(F.col("expected"), high, True)
    out = met.withColumns({"least": least, "most": most, "quality": J.quality(F.col("calls"))}).filter("bytes_out < least or bytes_out > most")
    evidence = F.concat(
        F.lit("J1:"), F.col("quality"), F.lit(" target="), T.target_text(F.col("host"), F.col("port")), F.lit(" expected_bytes="), F.col("expected").cast("string"), F.lit(" observed_bytes="), F.col("bytes_out").cast("string"),
        F.lit(" band_bytes="), F.col("least").cast("string"), F.lit(".."), F.col("most").cast("string"), F.lit(f" band_basis_points={low}..{high} flows="), F.col("flows").cast("string"), F.lit(" calls="), F.col("calls").cast("string"),
    )
    sure = F.when(F.col("quality") == "exact", "confirmed").otherwise("suspect")
    return out.select(F.lit(KINDS[3]).alias("kind"), sure.alias("confidence"), "provider_ref", F.col("flow_id").alias("primary_ref"), evidence.alias("evidence"))


def silences(points: DataFrame, events: DataFrame, flows: DataFrame, settings: Settings) -> DataFrame:
    """(reason, episodes, flows) of unmatched in-scope episodes that the code accounts for."""
    found = J.unmatched_episodes(E.episodes(flows, settings.join_tolerance_ms).filter("flow_scope = 'in_scope'"), events)
    return J.explained(found, points).filter("silenced is not null").groupBy(F.col("silenced").alias("reason")).agg(F.count("*").alias("episodes"), F.sum("flows").alias("flows"))


def findings(points: DataFrame | None, events: DataFrame | None, flows: DataFrame | None, settings: Settings | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Every finding that the run supports, one row per id, and the (kind, reason) of what it doesn't."""
    settings = settings or Settings()
    measured = None
    if flows is not None:
        seen = flows.agg(F.count("*").alias("n"), F.count("bytes_out").alias("counted")).first()
        measured = None if seen.n == 0 else seen.counted > 0
    stopped = suppressed(points is not None, events is not None, flows is not None, measured, settings)
    off = {k for k, _ in stopped}
    # Checked events and episodes are read by several derivations each, so they are worked out once.
    events = settle(events, "events") if events is not None and off != set(KINDS) else events
    episodes = settle(E.episodes(flows, settings.join_tolerance_ms), "episodes") if flows is not None and not off >= set(KINDS[2:]) else None
    made = []
    if KINDS[0] not in off:
        made.append(dormant(points, events, settings))
    if KINDS[1] not in off:
        made.append(drift(points, events))
    if KINDS[2] not in off:
        made.append(unmatched(points, events, flows, settings, episodes))
    if KINDS[3] not in off:
        made.append(volume(events, flows, settings, episodes))
    if not made:
        return None, stopped
    every = reduce(DataFrame.unionByName, made)
    rules = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    named = every.withColumn("rule_id", F.element_at(rules, F.col("kind"))).withColumn("finding_id", I.finding_identity(F.col("kind"), F.lit("reconciled"), F.col("primary_ref"), F.col("rule_id")))
    first = named.groupBy("finding_id").agg(F.min(F.struct("kind", "confidence", "provider_ref", "primary_ref", "rule_id", "evidence")).alias("f"))
    return first.select("finding_id", "f.*"), stopped


def references(points: DataFrame, events: DataFrame, flows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(kind, primary_ref, ref_type, ref_id), each once: what findings refer to.

    A point is referred to by what is found of it, the calls that drifted by its drift, all flows of an
    episode by what is found of the episode, and the calls that its bytes are measured by.
    """
    settings = settings or Settings()
    row = lambda kind, primary, ref, of: (F.lit(kind).alias("kind"), F.col(primary).alias("primary_ref"), F.lit(ref).alias("ref_type"), F.col(of).alias("ref_id"))
    own = points.select("ep_id")
    same = (F.col("host") == F.col("obs_host")) & F.col("port").eqNullSafe(F.col("obs_port"))
    drifted = points.filter("host is not null").join(events.filter("obs_host is not null"), F.col("operation") == F.col("ee_operation")).filter(~same)
    held = E.members(flows, settings.join_tolerance_ms).select("flow_id", "member").distinct()
    linked = J.wire_links(E.episodes(flows, settings.join_tolerance_ms), events).select("flow_id", "ee_id").distinct()
    made = [
        own.select(*row(KINDS[0], "ep_id", "egress_point", "ep_id")),
        own.select(*row(KINDS[1], "ep_id", "egress_point", "ep_id")),
        drifted.select(*row(KINDS[1], "ep_id", "egress_event", "ee_id")),
        held.select(*row(KINDS[2], "flow_id", "flow", "member")),
        held.select(*row(KINDS[3], "flow_id", "flow", "member")),
        linked.select(*row(KINDS[3], "flow_id", "egress_event", "ee_id")),
    ]
    return reduce(DataFrame.unionByName, made).distinct()


def collapsed(found: DataFrame, refs: DataFrame) -> DataFrame:
    """findings (finding_id, kind, primary_ref, evidence, ...) once each, with refs and evidence as sorted arrays of all of equal id, and lost: how many others had the id.

    Only references of what was found are gathered; a finding's list is as long as what it refers to.
    """
    one = found.groupBy("finding_id").agg(F.min(F.struct(*(c for c in found.columns if c not in ("finding_id", "evidence")))).alias("f"), F.array_sort(F.collect_set("evidence")).alias("evidence"), (F.count("*") - 1).alias("lost"))
    own = refs.join(found.select("kind", "primary_ref", "finding_id").distinct(), ["kind", "primary_ref"])
    lists = own.groupBy("finding_id").agg(F.array_sort(F.collect_set(F.struct("ref_type", "ref_id"))).alias("refs"))
    none = F.array().cast("array<struct<ref_type:string,ref_id:string>>")
    return one.join(lists, "finding_id", "left").select("finding_id", "f.*", "evidence", F.coalesce("refs", none).alias("refs"), "lost")


def reference_digests(found: DataFrame, points: DataFrame, events: DataFrame, flows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(finding_id, kind, n_refs, refs_sha256) of findings (finding_id, kind, primary_ref): how many references collapsed() would gather for each, and the digest of their 'type:id' in order, comma-joined.

    Only references of what was found are looked for. Points of equal operation and target refer to the same calls, and so do episodes of
    equal target: such a list is made once, and no finding's own copy of it is built unless the finding refers to several lists.
    """
    settings = settings or Settings()
    found = settle(found.select("finding_id", "kind", "primary_ref").distinct(), "found")
    of = lambda rows, kind, primary: found.filter(F.col("kind") == kind).join(rows.withColumnRenamed(primary, "primary_ref"), "primary_ref")
    ref = lambda kind, name: F.struct(F.lit(kind).alias("ref_type"), F.col(name).alias("ref_id")).alias("ref")
    # References of a finding's own, of types that come after those of calls.
    point_ids = points.select("ep_id", F.col("ep_id").alias("id")).distinct()
    held = E.members(flows, settings.join_tolerance_ms).select("flow_id", "member").distinct()
    own = [of(point_ids, k, "ep_id").select("finding_id", ref("egress_point", "id")) for k in KINDS[:2]]
    of_flows = found.filter(F.col("kind").isin(KINDS[2:])).select("finding_id", F.col("primary_ref").alias("flow_id"))
    own.append(held.join(of_flows, "flow_id").select("finding_id", ref("flow", "member")))
    # Lists of calls by their key, and the keys of each finding.
    key = lambda name, *cols: F.to_json(F.struct(F.lit(name).alias("list"), *cols), {"ignoreNullFields": "false"}).alias("key")
    same = (F.col("host") == F.col("obs_host")) & F.col("port").eqNullSafe(F.col("obs_port"))
    drifted = of(points.filter("host is not null and operation is not null").select("ep_id", "operation", "host", "port"), KINDS[1], "ep_id")
    # Episodes are worked out again only if bytes were found to deviate.
    some = not found.filter(F.col("kind") == KINDS[3]).isEmpty()
    by_operation, by_target = key("operation", "operation", "host", "port"), key("target", "host", "port")
    keys = drifted.select("finding_id", by_operation, "operation", "host", "port")
    if some:
        targets = of(E.episodes(flows, settings.join_tolerance_ms).select("flow_id", "host", F.coalesce("port", F.lit(-1)).alias("port")), KINDS[3], "flow_id")
        keys = keys.unionByName(targets.select("finding_id", by_target, F.lit(None).cast("string").alias("operation"), "host", F.col("port").cast("int").alias("port")))
    keys = settle(keys.distinct(), "list-keys")
    classes = keys.select("key", "operation", "host", "port").distinct()
    seen = events.filter("obs_host is not null").select("ee_operation", "obs_host", "obs_port", "ee_id").distinct()
    called = events.filter("wire_host is not null").select(F.col("wire_host").alias("host"), F.coalesce("wire_port", F.lit(-1)).cast("int").alias("port"), "ee_id").distinct()
    listed = classes.filter("operation is not null").join(seen, F.col("operation") == F.col("ee_operation")).filter(~same).select("key", "ee_id")
    listed = listed.unionByName(classes.filter("operation is null").join(called, ["host", "port"]).select("key", "ee_id"))
    named = lambda refs: F.array_join(F.transform(refs, lambda r: F.concat_ws(":", r["ref_type"], r["ref_id"])), ",")
    lists = listed.groupBy("key").agg(F.array_sort(F.collect_set(ref("egress_event", "ee_id"))).alias("calls"))
    lists = settle(lists.select("key", F.size("calls").alias("n"), named("calls").alias("text")), "lists")
    # The rare findings of several lists have them put together.
    several = keys.groupBy("finding_id").agg(F.count("*").alias("lists")).filter("lists > 1").select("finding_id")
    sole = keys.select("finding_id", "key").join(several, "finding_id", "left_anti").join(lists, "key").select("finding_id", "n", "text")
    joined = keys.select("finding_id", "key").join(several, "finding_id", "left_semi").join(listed, "key").select("finding_id", ref("egress_event", "ee_id"))
    joined = joined.groupBy("finding_id").agg(F.array_sort(F.collect_set("ref")).alias("refs")).select("finding_id", F.size("refs").alias("n"), named("refs").alias("text"))
    mine = reduce(DataFrame.unionByName, own).groupBy("finding_id").agg(F.array_sort(F.collect_set("ref")).alias("refs")).select("finding_id", F.size("refs").alias("own_n"), named("refs").alias("own_text"))
    one = found.groupBy("finding_id").agg(F.min("kind").alias("kind")).join(mine, "finding_id", "left").join(sole.unionByName(joined), "finding_id", "left")
    count = F.coalesce("n", F.lit(0)) + F.coalesce("own_n", F.lit(0))
    return one.select("finding_id", "kind", count.cast("long").alias("n_refs"), F.sha2(F.concat_ws(",", "text", "own_text"), 256).alias("refs_sha256"))


def fault_notes(collapsed_: DataFrame) -> DataFrame:
    """(fault): how many findings a collapse lost, no row if none."""
    lost = collapsed_.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("n")).filter("n > 0")
    return lost.select(F.concat(F.col("n").cast("string"), F.lit(" findings collapsed onto an identity that another one already held")).alias("fault"))
