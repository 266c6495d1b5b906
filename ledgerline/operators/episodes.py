"""Wire episodes: flows of one conversation whose gaps are within a tolerance, merged by a running maximum of end times.

Conversations are worked on in cells of time, so one that holds most flows is the work of many tasks: a
cell learns from one row a cell how far the flows before it reach, merges its own, and only its first and last
episodes meet those of other cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import targets as T

#: The tolerance that connections of one conversation have at least.
LEAST_TOLERANCE_MS = 1000
#: Rank order of the classifications.
CLASSES = ["classified", "unclassified", "opaque"]
#: Milliseconds of a cell of time.
CELL_MS = 900_000
CONVERSATION = ["host", "port", "pid", "pid_start_time", "flow_scope", "process_attribution"]


def tolerance(join_tolerance_ms: int = 250) -> int:
    return max(join_tolerance_ms, LEAST_TOLERANCE_MS)


def targeted(flows: DataFrame) -> DataFrame:
    """flows with the target that joins use: the resolved name, or else the address; and whether it is named."""
    name = T.normal_host(F.col("resolved_host"))
    host, start = F.coalesce(name, T.normal_host(F.col("dst_ip"))), F.col("t_start_bucket") * 1000
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("classification")).cast("int")
    made = {"named": name.isNotNull(), "host": host, "port": T.normal_port(F.col("dst_port")), "start_ms": start, "end_ms": start + F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)), "class_rank": rank}
    return flows.withColumns(made).filter("host is not null")


def readings(flows: DataFrame) -> DataFrame:
    """One row for each flow id of a conversation: repeated readings keep the largest count and the earliest position."""
    earliest = F.min(F.struct("start_ms", F.col("end_ms").alias("first_end"), "provider_ref")).alias("e")
    one = targeted(flows).groupBy("flow_id", *CONVERSATION).agg(F.max("end_ms").alias("end_ms"), F.max("bytes_out").alias("bytes_out"), F.max("class_rank").alias("class_rank"), F.every("named").alias("named"), earliest)
    return one.select("flow_id", *CONVERSATION, "e.start_ms", "end_ms", "bytes_out", "class_rank", "named", "e.provider_ref")


def _together(head: str) -> list[Column]:
    """What pieces of one episode make together."""
    return [
        F.min("flow_id").alias("flow_id"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum("bytes_out").alias("bytes_out"),
        F.sum("flows").alias("flows"),
        F.max("class_rank").alias("class_rank"),
        F.every("named").alias("named"),
        F.min(head).alias("head"),
    ]


def pieces(flows: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """Flows of a conversation that begin at the same time, as one piece, with the cell of time that they begin in."""
    head = F.struct("start_ms", F.col("end_ms").alias("until"), F.col("flow_id").alias("id"), F.col("provider_ref").alias("provider"))
    read = readings(flows).withColumns({"head": head, "flows": F.lit(1).cast("long"), "at": F.col("start_ms")})
    return read.groupBy(*CONVERSATION, "at").agg(*_together("head")).withColumn("cell", F.floor(F.col("at") / cell_ms)).drop("at")


def _cut(flows: DataFrame, limit: int, cell_ms: int) -> DataFrame:
    """The pieces of flows with part: the episode of its cell that a piece belongs to, 0 if it goes on with one of an earlier cell."""
    own = pieces(flows, cell_ms)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_cell = Window.partitionBy(*CONVERSATION).orderBy("cell")
    reach = own.groupBy(*CONVERSATION, "cell").agg(F.max("end_ms").alias("reach"))
    reach = reach.withColumn("carried", F.max("reach").over(earlier(by_cell))).drop("reach")
    order = Window.partitionBy(*CONVERSATION, "cell").orderBy("start_ms")
    # A cell's row of what is carried in stands before its pieces.
    rows = own.unionByName(reach.withColumnRenamed("carried", "end_ms"), allowMissingColumns=True)
    open_end = F.max("end_ms").over(earlier(order))
    fresh = F.col("start_ms").isNotNull() & (open_end.isNull() | (F.col("start_ms") - open_end > limit))
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(order)).filter("start_ms is not null")


def _parts(cut: DataFrame) -> DataFrame:
    """The parts of cells, with whether one is a whole episode (inner), and the chain that the others are links of."""
    parts = cut.groupBy(*CONVERSATION, "cell", "part").agg(*_together("head"))
    parts = parts.withColumn("last", F.max("part").over(Window.partitionBy(*CONVERSATION, "cell")))
    return parts.withColumn("inner", (F.col("part") > 0) & (F.col("part") < F.col("last")))


def _chained(parts: DataFrame) -> DataFrame:
    """The first and last parts of cells; part 0 goes on with what an earlier cell ended with."""
    chain = F.sum((F.col("part") > 0).cast("int")).over(Window.partitionBy(*CONVERSATION).orderBy("cell", "part"))
    return parts.filter("not inner").withColumn("chain", chain)


def episodes(flows: DataFrame, join_tolerance_ms: int = 250, cell_ms: int = CELL_MS) -> DataFrame:
    """Episodes: flow_id (the smallest), target, process, scope, attribution, span, bytes, flows, classification, provider (the earliest)."""
    parts = _parts(_cut(flows, tolerance(join_tolerance_ms), cell_ms))
    ends = _chained(parts).groupBy(*CONVERSATION, "chain").agg(*_together("head")).drop("chain")
    merged = parts.filter("inner").drop("cell", "part", "last", "inner").unionByName(ends)
    named = {"classification": F.element_at(F.array(*map(F.lit, CLASSES)), F.col("class_rank")), "provider_ref": F.col("head.provider")}
    return merged.withColumns(named).drop("class_rank", "head")


def _same_talk(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left (l) and right (r) joined by conversation, whose parts may be null, and keys."""
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in CONVERSATION] + [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])


def members(flows: DataFrame, join_tolerance_ms: int = 250, cell_ms: int = CELL_MS) -> DataFrame:
    """(flow_id, CONVERSATION, member): the flows of each episode, which is named by its smallest flow id and its conversation.

    A flow finds the part that its time was dealt to, and the part its episode: joins on a conversation's cells, not on conversations.
    """
    cut = _cut(flows, tolerance(join_tolerance_ms), cell_ms)
    parts = _parts(cut)
    links = _chained(parts)
    smallest = links.groupBy(*CONVERSATION, "chain").agg(F.min("flow_id").alias("episode"))
    ended = _same_talk(links, smallest, "chain").select(*(F.col(f"l.{c}") for c in (*CONVERSATION, "cell", "part")), "episode")
    whole = parts.filter("inner").select(*CONVERSATION, "cell", "part", F.col("flow_id").alias("episode"))
    dealt = _same_talk(readings(flows), cut.select(*CONVERSATION, "start_ms", "cell", "part"), "start_ms").select(*(F.col(f"l.{c}") for c in ("flow_id", *CONVERSATION)), "cell", "part")
    own = _same_talk(dealt, whole.unionByName(ended), "cell", "part")
    return own.select(F.col("episode").alias("flow_id"), *(F.col(f"l.{c}") for c in CONVERSATION), F.col("l.flow_id").alias("member"))


def bucket_counts(flows: DataFrame) -> DataFrame:
    """One row: flows by scope, and those without a classification, over all flows."""
    scopes = {"in_scope": "in_scope", "out_of_scope_process": "out_of_scope", "known_benign": "known_benign", "undetermined": "undetermined"}
    counts = [F.count_if(F.col("flow_scope") == k).alias(v) for k, v in scopes.items()]
    return flows.agg(*counts, F.count_if(F.col("classification") != "classified").alias("unclassified"))


def scope_tally(flows: DataFrame) -> DataFrame:
    """A row for each of the four scopes, zero where no flow has it."""
    counts = bucket_counts(flows)
    names = ["in_scope", "out_of_scope", "known_benign", "undetermined"]
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scope"), F.col(n).alias("n")) for n in names))).alias("s")).select("s.scope", "s.n")
