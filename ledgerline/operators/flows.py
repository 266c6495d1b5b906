"""Flow assembly from kernel events, name arbitration, and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests over which latency is told.
RECENT = 1024
ENCRYPTED_DNS_PORT = 853


def assembled(events: DataFrame) -> DataFrame:
    """Flows of events (key, at, event_id, kind: connect, volume or close, bytes), one for each life of a key.

    A life ends with a close. A connect opens it, or replaces its time; volume and close without an open
    life are orphans, which are counted with the life they fall in.
    """
    order = Window.partitionBy("key").orderBy("at", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    life = F.coalesce(F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(before), F.lit(0)).cast("long")
    lived = events.withColumn("incarnation", life)
    inside = Window.partitionBy("key", "incarnation").orderBy("at", "event_id")
    live = F.max((F.col("kind") == "connect").cast("int")).over(inside) == 1
    lived = lived.withColumn("live", live)
    is_kind = lambda k: F.col("kind") == k
    return lived.groupBy("key", "incarnation").agg(
        F.max(F.when(is_kind("connect"), F.col("at"))).alias("connected_at"),
        F.count_if(is_kind("volume") & F.col("live")).alias("volumes"),
        F.coalesce(F.sum(F.when(is_kind("volume") & F.col("live"), F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.bool_or(is_kind("close") & F.col("live")).alias("closed"),
        F.count_if(~is_kind("connect") & ~F.col("live")).alias("orphans"),
    )


def arbitrated(hello: Column, server_name: Column, names: Column, encrypted_dns: Column, names_dropped: Column) -> Column:
    """struct<sni, sni_source, resolved_host, resolved_host_source, degraded_reasons> of a flow.

    hello is server_name, encrypted or null. The client's own word wins over answers; names that disagree
    with it are told; an encrypted hello names nothing; else the first answer's name does.
    """
    own, hidden = hello == "server_name", hello == "encrypted"
    none = F.size(names) == 0
    source = F.when(own, F.when(~none & F.array_contains(names, server_name), "dns_and_sni").otherwise("sni")).when(F.coalesce(hidden, F.lit(False)) | none, F.lit(None)).otherwise("dns")
    host = F.when(own, server_name).when(F.coalesce(hidden, F.lit(False)), F.lit(None)).otherwise(F.array_min(names))
    reasons = F.array(
        F.when(own & ~none & ~F.array_contains(names, server_name), "dns_sni_mismatch"),
        F.when(hidden, "ech"),
        F.when(none & encrypted_dns, "encrypted_dns"),
        F.when(none & names_dropped, "map_overflow"),
    )
    return F.struct(
        F.when(own, server_name).alias("sni"),
        F.when(own, "client_hello").when(F.coalesce(hidden, F.lit(False)), "encrypted_client_hello").otherwise("absent").alias("sni_source"),
        host.alias("resolved_host"),
        source.alias("resolved_host_source"),
        F.filter(reasons, lambda r: r.isNotNull()).alias("degraded_reasons"),
    )


def encrypted_dns(events: DataFrame) -> DataFrame:
    """One row: whether an encrypted name service was seen and no answer was."""
    return events.agg((F.bool_or(F.col("dst_port") == ENCRYPTED_DNS_PORT) & (F.coalesce(F.sum("answers"), F.lit(0)) == 0)).alias("encrypted_dns"))


def loss(events: DataFrame) -> DataFrame:
    """One row: how many events were lost (lost: by each reading); null where any reading can't tell, or there is none."""
    return events.agg(F.when(F.count("*") == F.count("lost"), F.sum("lost")).alias("lost"))


def bounded_names(answers: DataFrame, addresses: int = 8192, names: int = 32) -> DataFrame:
    """The answers (ip, name, expiry) that a bounded map holds: of an address the first names, of addresses those that expire last."""
    latest = answers.groupBy("ip", "name").agg(F.max("expiry").alias("expiry"), F.min("at").alias("at"))
    own = Window.partitionBy("ip").orderBy("at", "name")
    kept = latest.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= names).drop("rank")
    top = kept.groupBy("ip").agg(F.max("expiry").alias("last")).orderBy(F.col("last").desc(), F.col("ip").desc()).limit(addresses)
    return kept.join(top.select("ip"), "ip", "left_semi").select("ip", "name", "expiry")


def shared_flow_ids(flows: DataFrame) -> DataFrame:
    """(flow_id, n) of flow ids that more than one network namespace reports; no namespace is one of its own."""
    return flows.groupBy("flow_id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("netns").cast("string"), F.lit("-"))).alias("spaces")).filter("spaces > 1").select("flow_id", "n")


def latency(requests: DataFrame) -> DataFrame:
    """One row: nearest-rank quantiles of ms over the newest requests (ms, ts, event_id); a top-k, not a global sort."""
    recent = requests.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(RECENT)
    return recent.agg(*(F.expr(f"percentile_disc({q}) within group (order by ms)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))), F.count("*").alias("n"))


def request_counters(requests: DataFrame) -> DataFrame:
    """One row of counters over requests (status, masked, reassembly_errors)."""
    return requests.agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("refusals"), F.coalesce(F.sum("masked"), F.lit(0)).alias("masked"), F.coalesce(F.sum("reassembly_errors"), F.lit(0)).alias("reassembly_errors"))


def metrics_text(counters: dict[str, int], quantiles: dict[str, float], prefix: str = "ledgerline") -> str:
    """Counters and quantiles in the text form that monitoring systems scrape."""
    lines = []
    for name, value in counters.items():
        lines += [f"# TYPE {prefix}_{name}_total counter", f"{prefix}_{name}_total {value}"]
    lines += [f"# TYPE {prefix}_latency_ms summary", *(f'{prefix}_latency_ms{{quantile="{q}"}} {v}' for q, v in quantiles.items())]
    return "\n".join(lines) + "\n"
