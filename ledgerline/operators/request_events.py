"""One record per masked request, as a nested row and as JSON: what was masked, allowed and aliased, by type; never a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.gateway import alias_stats, allowed_stats

#: How sure the layers are.
BUCKETS = {"pattern": "deterministic", "dictionary": "deterministic", "ner": "low"}
#: What is told of a request as it is, of its times, its stream, its aliases and what came back, in the order of their names.
HEADER = ["alias_style", "masking_profile", "policy_hash", "policy_version", "ruleset_hash", "session_scope"]
LATENCY = ["alias", "detect", "stream_hold_total", "total"]
STREAM = ["chunks", "hold_events", "hold_timeout_flush", "hold_timeout_flush_depth_max", "l_max_session", "l_max_static", "max_buffer_bytes", "partial_alias_flushed"]
ALIASES = ["alias_length_class_capped", "alias_pool_exhausted"]
RESTORED = ["aliases_leaked", "aliases_restored", "aliases_seen_in_response"]


def json_quote(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    pairs = [("\\", "\\\\"), ('"', '\\"'), *((chr(c), short.get(chr(c), f"\\u{c:04x}")) for c in range(32))]
    body = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    # Few texts hold a character that is escaped; the others are read once.
    return F.concat(F.lit('"'), F.when(text.rlike(r'["\\\x00-\x1F]'), body).otherwise(text), F.lit('"'))


def _numbers(names: list[str], columns: list[str]) -> Column:
    """Counts by name, 0 where the request has no such column or no value."""
    return F.struct(*(F.coalesce(F.col(n).cast("long") if n in columns else F.lit(None), F.lit(0)).cast("long").alias(n) for n in names))


def request_events(requests: DataFrame, masked: DataFrame, allowed: DataFrame, version: str = "1.0") -> DataFrame:
    """request_id and event of requests (request_id, HEADER, counts of LATENCY, STREAM, ALIASES and RESTORED as far as there are, degraded).

    masked are spans (request_id, entity, layer, rung, reused), allowed are spans (request_id, entity, scope, path_no,
    start). Types are in order of their names, and so are all fields. A count that isn't there is 0; a request without spans has empty lists.
    """
    per_layer = masked.groupBy("request_id", "entity", "layer").agg(F.count("*").alias("count"))
    bucket = F.element_at(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv)), F.col("layer"))
    hidden = per_layer.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("entity", "layer", "count", bucket.alias("bucket")))).alias("hidden"))
    open_ = allowed_stats(allowed).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("entity", "n", "scope"))).alias("open"))
    made = alias_stats(masked).groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", F.struct(F.col("n").alias("count"), F.col("rung").alias("ladder_rung")).alias("stat"))))).alias("by_type"))
    rows = requests.join(hidden, "request_id", "left").join(open_, "request_id", "left").join(made, "request_id", "left")
    masks = F.transform("hidden", lambda s: F.struct(s["bucket"].alias("confidence_bucket"), s["count"].alias("count"), s["layer"].alias("layer"), s["entity"].alias("type")))
    allows = F.transform("open", lambda s: F.struct(s["n"].alias("count"), s["scope"].alias("rule_scope"), s["entity"].alias("type")))
    none = lambda column, like: F.coalesce(column, F.filter(like, lambda _: F.lit(False)), F.array())
    columns = requests.columns
    extra = {name: F.col(name).cast("string") for name in HEADER}
    aliases = F.struct(*(_numbers(ALIASES, columns)[n].alias(n) for n in ALIASES), F.coalesce("by_type", F.create_map().cast("map<string,struct<count:bigint,ladder_rung:string>>")).alias("by_type"))
    fields = {
        **extra,
        "alias_stats": aliases,
        "degraded_reasons": F.array_sort(F.array_distinct(F.coalesce("degraded", F.array().cast("array<string>")))),
        "derived_dates_seen": F.lit(0).cast("long"),
        "entities_allowed": none(allows, allows),
        "entities_masked": none(masks, masks),
        "latency_ms": _numbers(LATENCY, columns),
        "restore_stats": _numbers(RESTORED, columns),
        "schema_version": F.lit(version),
        "stream_stats": _numbers(STREAM, columns),
        "unmasked_candidates": F.array().cast("array<string>"),
        "vault_record_tamper": F.lit(0).cast("long"),
    }
    return rows.select("request_id", F.struct(*(fields[n].alias(n) for n in sorted(fields))).alias("event"))


def event_json(events: DataFrame) -> DataFrame:
    """request_id and json, one line each."""
    return events.select("request_id", F.to_json("event", {"ignoreNullFields": "false"}).alias("json"))
