"""Joins of declared points, runtime events and wire episodes.

The tiered join is three equi-joins whose results can't overlap: by operation (its tier says whether the
targets agree too), by target where operations don't agree, by provider where neither does. So no link
needs to be deduplicated, and no condition with OR reaches the planner. Few operations and providers have most
of the pairs; theirs are cut into blocks, so that the work is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import targets as T
from ledgerline.functions.tables import maybe_broadcast, settle

#: Points and events of a block of pairs that is joined as one.
SIDE = 1000

TIERS = ["operation_and_target", "operation_only", "target_only", "provider_only"]


def observed_events(events: DataFrame) -> DataFrame:
    """ee_id, operation, provider_ref, byte_size_estimate and the targets as both joins read them.

    obs_host and obs_port are null where the call's target was not resolved; the wire join only looks at
    the host that was written.
    """
    host = F.when(F.col("host_id") != T.UNKNOWN, T.normal_host(F.col("host_id")))
    port = F.when(F.col("host_id") != T.UNKNOWN, T.normal_port(F.col("port")))
    read = ~F.coalesce(F.col("target_unresolved"), F.lit(False))
    return events.select(
        F.col("egress_event_id").alias("ee_id"),
        F.col("operation").alias("ee_operation"),
        F.col("provider_ref").alias("ee_provider"),
        "byte_size_estimate",
        F.when(read, host).alias("obs_host"),
        F.when(read, port).alias("obs_port"),
        host.alias("wire_host"),
        port.alias("wire_port"),
    )


def _same_target() -> Column:
    return (F.col("host") == F.col("obs_host")) & F.col("port").eqNullSafe(F.col("obs_port"))


def links(points: DataFrame, events: DataFrame) -> DataFrame:
    """(ep_id, ee_id, tier, obs_host, obs_port): each pair that is linked, with its strongest tier."""
    points, events = settle(points, "link-points"), settle(events, "link-events")
    same_operation = F.col("operation") == F.col("ee_operation")
    same_target = F.coalesce(_same_target(), F.lit(False))
    out = ["ep_id", "ee_id", "tier", "obs_host", "obs_port"]
    by_operation = _paired(points, events, [("operation", "ee_operation")]).withColumn("tier", F.when(same_target, 0).otherwise(1))
    ports = (F.coalesce("port", F.lit(-1)), F.coalesce("obs_port", F.lit(-1)))
    by_target = _paired(points, events, [("host", "obs_host"), ports]).filter(~F.coalesce(same_operation, F.lit(False))).withColumn("tier", F.lit(2))
    named = points.filter(F.col("provider_ref") != T.UNKNOWN)
    by_provider = _paired(named, events, [("provider_ref", "ee_provider")]).filter(~F.coalesce(same_operation, F.lit(False)) & ~same_target).withColumn("tier", F.lit(3))
    return by_operation.select(*out).unionByName(by_target.select(*out)).unionByName(by_provider.select(*out))


def _paired(points: DataFrame, events: DataFrame, keys: list[tuple[str | Column, str | Column]]) -> DataFrame:
    """points and events with equal keys, an inner join whose work is spread however few keys there are.

    The pairs of a key are a field of its points by its events. A field of more than SIDE * SIDE pairs is cut into blocks of
    about SIDE by SIDE, each of which is a key of its own; so rows are copied once in SIDE pairs. There are fewer such keys than
    there are SIDE * SIDE pairs.
    """
    spark, names = points.sparkSession, [f"__k{i}" for i in range(len(keys))]
    keyed = lambda rows, side: rows.withColumns({n: F.col(k[side]) if isinstance(k[side], str) else k[side] for n, k in zip(names, keys, strict=True)}).dropna(subset=names)
    left, right = keyed(points, 0), keyed(events, 1)
    many = left.groupBy(names).agg(F.count("*").alias("p")).join(right.groupBy(names).agg(F.count("*").alias("e")), names).filter(F.col("p") * F.col("e") > SIDE * SIDE)
    many = maybe_broadcast(settle(many.select(*names, F.ceil(F.col("p") / SIDE).cast("int").alias("rows"), F.ceil(F.col("e") / SIDE).cast("int").alias("columns")), "link-fields"))
    block = [*names, "__row", "__column"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, id: str, own: str, own_cuts: str, other: str, other_cuts: str) -> DataFrame:
        cut = rows.join(many, names, "left").withColumn(own, F.pmod(F.xxhash64(id), F.coalesce(own_cuts, F.lit(1))).cast("int"))
        # The number of partitions is given, since few bytes of rows make many pairs.
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_cuts, F.lit(1)) - 1))).drop("rows", "columns").repartition(parts, *block)

    return dealt(left, "ep_id", "__row", "rows", "__column", "columns").join(dealt(right, "ee_id", "__column", "columns", "__row", "rows"), block)


def tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), tier + 1)


def unlinked_events(points: DataFrame, events: DataFrame) -> DataFrame:
    """ee_id of the events that no point links to: three anti-joins on distinct keys, no pair is built."""
    operations = points.select(F.col("operation").alias("ee_operation")).filter("ee_operation is not null").distinct()
    hosts = points.filter("host is not null").select(F.col("host").alias("obs_host"), F.coalesce("port", F.lit(-1)).alias("obs_key")).distinct()
    providers = points.filter(F.col("provider_ref") != T.UNKNOWN).select(F.col("provider_ref").alias("ee_provider")).distinct()
    left = events.withColumn("obs_key", F.coalesce("obs_port", F.lit(-1))).join(operations, "ee_operation", "left_anti").join(hosts, ["obs_host", "obs_key"], "left_anti")
    return left.join(providers, "ee_provider", "left_anti").select("ee_id").distinct()


def point_tiers(points: DataFrame, events: DataFrame) -> DataFrame:
    """points with tier, the strongest link of each, null without one: lookups of distinct keys, no pair is built."""
    keys = events.select("ee_operation", "obs_host", "obs_port").distinct()
    both = keys.filter("obs_host is not null").withColumn("t0", F.lit(0)).select(F.col("ee_operation").alias("operation"), F.col("obs_host").alias("host"), F.coalesce("obs_port", F.lit(-1)).alias("key"), "t0").distinct()
    operation = keys.select(F.col("ee_operation").alias("operation"), F.lit(1).alias("t1")).distinct()
    target = keys.filter("obs_host is not null").select(F.col("obs_host").alias("host"), F.coalesce("obs_port", F.lit(-1)).alias("key"), F.lit(2).alias("t2")).distinct()
    provider = events.filter(F.col("ee_provider") != T.UNKNOWN).select(F.col("ee_provider").alias("provider_ref"), F.lit(3).alias("t3")).distinct()
    seen = points.withColumn("key", F.coalesce("port", F.lit(-1))).join(both, ["operation", "host", "key"], "left").join(operation, "operation", "left").join(target, ["host", "key"], "left").join(provider, "provider_ref", "left")
    return seen.withColumn("tier", F.coalesce("t0", "t1", "t2", "t3")).select(*points.columns, "tier")


def event_targets(events: DataFrame) -> DataFrame:
    """(host, key, calls, bytes, unsized) of the distinct events of each target that the wire join reads."""
    return (
        events.filter("wire_host is not null")
        .groupBy(F.col("wire_host").alias("host"), F.coalesce("wire_port", F.lit(-1)).alias("key"))
        .agg(F.count("*").alias("calls"), F.sum("byte_size_estimate").alias("bytes"), F.count_if(F.col("byte_size_estimate") == 0).alias("unsized"))
    )


def wire_links(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """(flow_id, ee_id, quality): each event whose target is that of an episode. There is no condition on time or process."""
    calls = events.filter("wire_host is not null").select(F.col("wire_host").alias("host"), F.coalesce("wire_port", F.lit(-1)).alias("key"), "ee_id")
    found = episodes.withColumn("key", F.coalesce("port", F.lit(-1))).join(event_targets(events).select("host", "key", "calls"), ["host", "key"]).withColumn("quality", quality(F.col("calls")))
    return found.join(calls, ["host", "key"]).select("flow_id", "ee_id", "quality")


def quality(calls: Column) -> Column:
    return F.when((calls == 1) & F.col("named") & (F.col("process_attribution") == "kernel_attributed"), "exact").otherwise("ambiguous")


def unmatched_episodes(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Episodes none of whose flow id's targets an event has."""
    keyed = episodes.withColumn("key", F.coalesce("port", F.lit(-1)))
    matched = keyed.join(event_targets(events).select("host", "key"), ["host", "key"], "left_semi").select("flow_id").distinct()
    return episodes.join(matched, "flow_id", "left_anti")


def unreadable_events(events: DataFrame) -> DataFrame:
    """One row: how many events have no target that the wire join can read."""
    return events.filter("wire_host is null").agg(F.count_distinct("ee_id").alias("unreadable"))


def explained(episodes: DataFrame, points: DataFrame) -> DataFrame:
    """episodes with silenced: 'target' if a point declares the same target, 'provider' if one has the same known provider, else null."""
    targets = points.filter("host is not null").select("host", F.coalesce("port", F.lit(-1)).alias("key"), F.lit(True).alias("by_target")).distinct()
    providers = points.filter(F.col("provider_ref") != T.UNKNOWN).select("provider_ref", F.lit(True).alias("by_provider")).distinct()
    out = episodes.withColumn("key", F.coalesce("port", F.lit(-1))).join(targets, ["host", "key"], "left").join(providers, "provider_ref", "left")
    return out.withColumn("silenced", F.when(F.col("by_target"), "target").when(F.col("by_provider"), "provider")).select(*episodes.columns, "silenced")


def named_at(flows: DataFrame, answers: DataFrame, least: int = 30, most: int = 3600) -> DataFrame:
    """flows (flow_id, dst_ip, at) with dns_names: names of answers (ip, name, at, ttl) that held at the flow's time.

    An answer holds from its time for its lifetime, which is kept between least and most seconds; times are
    whole seconds. A sweep, which pairs no flow with an answer: the spans of each name of an address are merged, their
    ends cut the address's line into stretches with a set of names each, and a flow takes the set of the
    stretch it falls in. The line is worked on in cells of most seconds, and in each only distinct seconds
    are put in order, so no group grows with the answers or the flows of an address.
    """
    asked = flows.select(F.col("dst_ip").alias("ip"), "at").filter("ip is not null and at is not null").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("at") / most))
    spans = merged_spans(answers, least, most)
    edges = spans.select("ip", "cell", F.explode(F.array("since", "until")).alias("t"), F.lit(True).alias("edge"), F.lit(False).alias("ask"))
    times = edges.unionByName(asked.select("ip", "cell", F.col("at").alias("t"), F.lit(False).alias("edge"), F.lit(True).alias("ask")))
    times = times.groupBy("ip", "cell", "t").agg(F.bool_or("edge").alias("edge"), F.bool_or("ask").alias("ask"))
    line = Window.partitionBy("ip", "cell").orderBy("t")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    # Stretches count from each edge on; those that a flow asks for have a number of their own.
    laid = times.withColumn("stretch", F.sum(F.col("edge").cast("int")).over(line))
    last = F.max(F.when(F.col("ask"), F.col("stretch"))).over(before)
    laid = laid.withColumn("first", (F.col("ask") & (last.isNull() | (last < F.col("stretch")))).cast("int"))
    laid = laid.withColumn("passed", F.coalesce(F.sum("first").over(before), F.lit(0)))
    place = lambda t, name: laid.filter("edge").select("ip", "cell", F.col("t").alias(t), F.col("passed").alias(name))
    held = spans.join(place("since", "begin"), ["ip", "cell", "since"]).join(place("until", "end"), ["ip", "cell", "until"]).filter("begin < end")
    held = held.select("ip", "cell", "name", F.explode(F.sequence("begin", F.col("end") - 1)).alias("number"))
    sets = held.groupBy("ip", "cell", "number").agg(F.array_sort(F.collect_set("name")).alias("dns_names"))
    points = laid.filter("ask").select("ip", "cell", F.col("t").alias("at"), (F.col("passed") + F.col("first") - 1).alias("number"))
    told = points.join(sets, ["ip", "cell", "number"]).select(F.col("ip").alias("dst_ip"), "at", "dns_names")
    return flows.join(told, ["dst_ip", "at"], "left").select("flow_id", F.coalesce("dns_names", F.array().cast("array<string>")).alias("dns_names"))


def merged_spans(answers: DataFrame, least: int = 30, most: int = 3600) -> DataFrame:
    """(ip, cell, name, since, until): when each name of an address holds, in disjoint spans that end at the borders of cells of most seconds."""
    life = F.least(F.greatest("ttl", F.lit(least)), F.lit(most))
    spans = answers.filter("ip is not null and name is not null").select("ip", "name", F.col("at").alias("since"), (F.col("at") + life).alias("until"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") / most), F.floor((F.col("until") - 1) / most))))
    parts = cells.select("ip", "name", "cell", F.greatest("since", F.col("cell") * most).alias("since"), F.least("until", (F.col("cell") + 1) * most).alias("until"))
    parts = parts.groupBy("ip", "name", "cell", "since").agg(F.max("until").alias("until"))
    order = Window.partitionBy("ip", "name", "cell").orderBy("since")
    reached = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("fresh", (reached.isNull() | (F.col("since") > reached)).cast("int"))
    numbered = fresh.withColumn("span", F.sum("fresh").over(order))
    return numbered.groupBy("ip", "name", "cell", "span").agg(F.min("since").alias("since"), F.max("until").alias("until")).select("ip", "cell", "name", "since", "until")
