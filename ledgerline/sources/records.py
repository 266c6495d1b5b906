"""Event streams with their status files, and flow files: explicit schemas, and a reason for every rejected line."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.tables import maybe_broadcast, settle

EVENT = (
    "schema_version string, egress_event_id string, process struct<language:string,runtime:string,entrypoint_hint:string>, library struct<module:string,mechanism:string>, operation string,"
    " target struct<host_id:string,port:int,path_template:string,provider_ref:string>, payload_shape struct<field_paths:array<string>,byte_size_estimate:bigint,truncated_depth:int>,"
    " call_site_hint struct<path:string,symbol:string>, degraded_reasons array<string>"
)
FLOW = (
    "schema_version string, flow_id string, host_id string, boot_id string, netns string, t_start_bucket bigint, duration_ms bigint, five_tuple struct<src_port:int,dst_ip:string,dst_port:int,proto:string>, interface string,"
    " resolved_host string, resolved_host_source string, sni string, sni_source string, dns_names array<string>, provider_ref string, classification string, provider_confidence string, ruleset_version string,"
    " process_attribution string, process struct<pid:bigint,pid_start_time:bigint,comm:string,exe:string,cmdline_hash:string>, flow_scope string, bytes_out bigint, bytes_in bigint, segments_out bigint, mechanism string, degraded_reasons array<string>"
)
STATUS = "hook_status string, reason string, dropped_events_count bigint, written_events_count bigint, failures array<string>, observation_window_ms bigint"
SAFE_TOKEN = r"^[a-z0-9_.:-]{1,64}$"
FAILURES = 16


def _keys(ddl: str) -> list[str]:
    """Top-level field names of a schema in DDL."""
    out, depth, name = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(name.split()[0])
            name = ""
        else:
            name += c
    return out


def _record(text: Column, ddl: str) -> Column:
    """The record, null if the text isn't one object with known fields."""
    known = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, _keys(ddl))))) == 0
    return F.when(known, F.from_json(text, ddl, {"mode": "PERMISSIVE"}))


def _file() -> Column:
    """The name of a row's file, as it is written in the folder."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _lines(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """(file, path, line, raw) of the non-blank lines of matching files, in as many tasks as their splits.

    A line's number is its place in its split after the number of lines in the file's earlier splits, which one pass counts.
    """
    text = spark.read.text(directory, pathGlobFilter=pattern, recursiveFileLookup=False, lineSep="\n")
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    rows = text.select(*split, F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select("path", "block", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start")), "splits")
    lines = text.select(*split, _file().alias("file"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    numbered = lines.join(maybe_broadcast(starts), ["path", "block"])
    return numbered.filter(F.trim("raw") != "").select("file", "path", (F.col("id") - F.col("start") + 1).alias("line"), "raw")


def read_events(spark: SparkSession, directory: str) -> DataFrame:
    """Event lines of *.jsonl files: file, line, event, reject."""
    rows = _lines(spark, directory, "*.jsonl").withColumn("event", _record(F.col("raw"), EVENT))
    broken = F.col("event").isNull() | F.col("event.egress_event_id").isNull() | F.col("event.operation").isNull() | F.col("event.target.host_id").isNull()
    return rows.select("file", "line", "event", F.when(broken, F.concat(F.lit("unparsable_record "), F.col("file"), F.lit(":"), F.col("line").cast("string"))).alias("reject"))


def stream_events(spark: SparkSession, directory: str) -> DataFrame:
    """The same lines as a stream; line numbers need whole files, so a stream has none."""
    raw = spark.readStream.option("pathGlobFilter", "*.jsonl").text(directory)
    return raw.filter(F.trim("value") != "").select(_record(F.col("value"), EVENT).alias("event"))


def read_status(spark: SparkSession, directory: str) -> DataFrame:
    """Status files: stream (the file that one is about), counts and window; a hook that isn't active watched for no time."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.status.json").select(F.regexp_replace(_file(), r"\.status\.json$", "").alias("stream"), F.from_json("value", STATUS).alias("s"))
    window = F.when(F.col("s.hook_status") == "active", F.col("s.observation_window_ms")).otherwise(F.lit(0))
    safe = F.slice(F.filter(F.coalesce("s.failures", F.array().cast("array<string>")), lambda t: t.rlike(SAFE_TOKEN)), 1, FAILURES)
    return raw.select("stream", F.col("s.hook_status").alias("hook_status"), F.coalesce("s.dropped_events_count", F.lit(0)).alias("dropped"), window.alias("window_ms"), safe.alias("failures"))


def with_status(events: DataFrame, status: DataFrame) -> DataFrame:
    """A row per stream: events, rejects, dropped and window; a stream without a status file is unmeasured."""
    per = events.groupBy("file").agg(F.count_if(F.col("reject").isNull()).alias("events"), F.count_if(F.col("reject").isNotNull()).alias("rejects"))
    return per.join(status, F.col("file") == F.col("stream"), "left").select("file", "events", "rejects", "dropped", "window_ms")


def collected(streams: DataFrame) -> DataFrame:
    """One row: events, everything dropped, and the window: the shortest, null if any is unmeasured."""
    return streams.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        (F.coalesce(F.sum("rejects"), F.lit(0)) + F.coalesce(F.sum("dropped"), F.lit(0))).alias("dropped"),
        F.when(~F.bool_or(F.col("window_ms").isNull()), F.min("window_ms")).alias("window_ms"),
    )


def read_flows(spark: SparkSession, directory: str) -> DataFrame:
    """Flow records of *.json and *.jsonl files, which hold an array, one object, or an object per line: file, flow; whole duplicates go.

    Files are read by lines. Only those in which some line isn't an object (an array, an object over several lines, a
    broken line) are read whole, by their names.
    """
    lines = _lines(spark, directory, "*.{json,jsonl}")
    is_object = F.json_object_keys("raw").isNotNull() & F.ltrim("raw").startswith("{")
    whole = [r.path for r in lines.filter(~is_object).select("path").distinct().collect()]
    objects = lines.filter(~F.col("path").isin(whole)).select("file", F.from_json("raw", FLOW).alias("flow"))
    if whole:
        objects = objects.unionByName(_whole_flows(spark, [unquote(p) for p in whole]))
    return objects.filter("flow is not null").dropDuplicates(["flow"])


def _whole_flows(spark: SparkSession, paths: list[str]) -> DataFrame:
    whole = spark.read.text(paths, wholetext=True).select(_file().alias("file"), F.btrim("value", F.lit(" \t\r\n")).alias("value"))
    array = F.from_json("value", F.lit(f"array<struct<{_nested(FLOW)}>>"))
    by_line = F.json_object_keys(F.regexp_extract("value", r"^[^\n]*", 0)).isNotNull()
    one = F.when(F.json_object_keys("value").isNotNull() & ~by_line, F.col("value"))
    kinds = whole.withColumn("one", one)
    arrays = kinds.filter(F.col("value").startswith("[")).select("file", F.explode(array).alias("flow"))
    lines = kinds.filter(~F.col("value").startswith("[")).select("file", F.explode(F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.split("value", "\n"))).alias("raw"))
    return arrays.unionByName(lines.filter(F.trim("raw") != "").select("file", F.from_json("raw", FLOW).alias("flow")))


def _nested(ddl: str) -> str:
    """A row's DDL as the inside of a struct: the space after a field's name becomes a colon."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


def write_flows(flows: DataFrame, path: str) -> None:
    """Flows as JSON lines, overwritten even when there are none."""
    flows.write.mode("overwrite").json(path)
