"""Requests as rows: routes, upstream hosts, headers, refusals, tool arguments, counts and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import mask as M

#: Method, path, treatment and provider of the routes that are known exactly.
ROUTES = [
    ("POST", "/v1/chat/completions", "masked_round_trip", "openai"),
    ("POST", "/v1/embeddings", "masked_one_way", "openai"),
    ("GET", "/v1/models", "no_user_text", "openai"),
    ("POST", "/anthropic/v1/messages", "masked_round_trip", "anthropic"),
    ("GET", "/anthropic/v1/models", "no_user_text", "anthropic"),
]
#: Path prefixes that are refused, and those that pass unmasked and are declared.
REFUSED = ["/v1/images", "/v1/audio", "/v1/batches", "/anthropic/v1/batches"]
UNMASKED = ["/v1/responses", "/v1/assistants", "/v1/threads"]
OWN_PATHS = ["/admin/policy", "/admin/vault/status", "/admin/metrics", "/_ledgerline/health"]
SESSION_PATH = "/_ledgerline/session/"
#: Headers that end at each hop, and those that carry credentials.
HOP_HEADERS = "connection content-length host keep-alive proxy-authenticate proxy-authorization proxy-connection te trailer transfer-encoding upgrade".split()
SECRET_HEADERS = "authorization api-key x-api-key x-goog-api-key cookie set-cookie".split()
OWN_PREFIX = "x-ledgerline-"
#: Status of each refusal.
STATUS = {
    "vault_unavailable": 503,
    "vault_integrity_failed": 503,
    "vault_record_tamper": 503,
    "policy_unloadable": 503,
    "alias_collision_unresolved": 503,
    "alias_limit_exceeded": 429,
    "entity_blocked": 400,
    "body_unparsable": 400,
    "endpoint_unsupported": 400,
    "tool_arguments_rejected": 400,
}


def _under(path: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (path == p) | path.startswith(p + "/")
    return hit


def treatment(method: Column, path: Column) -> Column:
    """What happens to a request: a treatment, own, endpoint_unsupported, not_found or method_not_allowed."""
    known = F.lit(None).cast("string")
    for verb, exact, what, _ in ROUTES:
        known = F.when(path == exact, F.when(method == verb, what).otherwise("method_not_allowed")).otherwise(known)
    session = F.substring(path, len(SESSION_PATH) + 1, 1000)
    return (
        F.when(path.isin(OWN_PATHS), F.when(method == "GET", "own").otherwise("method_not_allowed"))
        .when(path.startswith(SESSION_PATH), F.when(method != "GET", "method_not_allowed").when((session == "") | session.contains("/"), "not_found").otherwise("own"))
        .when(path.startswith("/admin/") | (path == "/v1/messages"), "not_found")
        .when(_under(path, REFUSED), "endpoint_unsupported")
        .when(_under(path, UNMASKED), "unmasked_and_declared")
        .otherwise(F.coalesce(known, F.lit("not_found")))
    )


def upstream_fault(url: Column, allowed: list[str]) -> Column:
    """Why a base URL can't be used, null if it can: it needs a scheme, an allowed host, and no user, query or way up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)", 1)
    prefix = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)(?::[0-9]{1,5})?$", 1))
    loopback = host.isin("localhost", "[::1]") | host.rlike(r"^127(\.[0-9]{1,3}){3}$")
    return (
        F.when(scheme == "", "not_absolute")
        .when(authority.contains("@"), "user_in_authority")
        .when(authority.rlike("[?#]") | prefix.rlike(r"[?#]"), "not_a_base")
        .when(host == "", "no_host")
        .when(~host.isin([h.lower() for h in allowed]), "host_not_allowed")
        .when(~((scheme == "https") | ((scheme == "http") & loopback)), "plaintext")
        .when(prefix.rlike(r"(^|/)\.\.(/|$)"), "way_up")
    )


def forwarded_headers(headers: Column) -> Column:
    """A request's headers that go on: neither those of a hop nor our own."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(HOP_HEADERS) & ~F.lower(k).startswith(OWN_PREFIX))


def told_headers(headers: Column) -> Column:
    """Headers that may stand in a log: credentials are left out."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(SECRET_HEADERS))


def has_tool_arguments(body: Column) -> Column:
    """Whether a request's JSON text carries tool arguments: top-level tool keys, calls in a message, or tool blocks in its content."""
    v = F.try_parse_json(body)
    top = F.lit(False)
    for key in ("tools", "tool_choice", "functions", "function_call"):
        top = top | F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) != "VOID", F.lit(False))
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    filled = lambda m, key: F.coalesce(F.schema_of_variant(F.try_variant_get(m, f"$.{key}", "variant")) != "VOID", F.lit(False))
    blocks = lambda m: F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    inside = F.exists(messages, lambda m: filled(m, "tool_calls") | filled(m, "function_call") | F.exists(blocks(m), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string").isin("tool_use", "tool_result"), F.lit(False))))
    return F.coalesce(top | inside, F.lit(False))


def status(refusal: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v)))), refusal)


def alias_stats(spans: DataFrame) -> DataFrame:
    """(request_id, entity, n, rung) of masked spans (request_id, entity, rung, reused): new aliases, and the weakest claim among them."""
    rank = F.array_position(F.array(*map(F.lit, M.RUNGS)), F.col("rung")).cast("int")
    return spans.filter("not reused").groupBy("request_id", "entity").agg(F.count("*").alias("n"), F.max_by("rung", rank).alias("rung"))


def allowed_stats(spans: DataFrame) -> DataFrame:
    """(request_id, entity, n, scope) of allowed spans (request_id, entity, scope, path_no, start): the scope of the first as they are applied, from the end of a text."""
    return spans.groupBy("request_id", "entity").agg(F.count("*").alias("n"), F.min_by("scope", F.struct(F.col("path_no"), (-F.col("start")).alias("s"))).alias("scope"))


def newest(rows: DataFrame, keep: int = 4096) -> DataFrame:
    """The newest rows (ts, id) that a ring keeps, with how many it let go."""
    kept = rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(keep)
    gone = rows.agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("evicted"))
    return kept.join(F.broadcast(gone))


def label_numbers(values: DataFrame) -> DataFrame:
    """values (session, entity, value, at) with label: numbers by first appearance in a session and type."""
    first = values.groupBy("session", "entity", "value").agg(F.min("at").alias("at"))
    return first.withColumn("label", F.concat_ws("_", "entity", F.row_number().over(Window.partitionBy("session", "entity").orderBy("at", "value")).cast("string")))


def log_line(fields: dict[str, Column]) -> Column:
    """k=v pairs in the given order; nulls are left out."""
    return F.concat_ws(" ", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in fields.items()))


def declared_passthrough(requests: DataFrame) -> DataFrame:
    """One confirmed finding per (scope, provider, rule) of requests (scope, provider_ref, treatment, tool_arguments) that pass unmasked."""
    rule = F.when(F.col("treatment") == "unmasked_and_declared", "endpoint_unsupported_passthrough").when(F.col("tool_arguments"), "tool_arguments_passthrough")
    hit = requests.withColumn("rule_id", rule).filter("rule_id is not null")
    return hit.groupBy("scope", "provider_ref", "rule_id").agg(F.count("*").alias("requests")).withColumns({"kind": F.lit("unmasked_passthrough"), "confidence": F.lit("confirmed"), "finding_id": F.concat(F.lit("fnd_"), F.substring(F.sha2(F.concat_ws(chr(31), "scope", "provider_ref", "rule_id"), 256), 1, 16))})
