"""Evidence tables derived from the driver's tables, written once as SQL that Spark and DuckDB both run.

events stands for recorded runtime calls, supplier for declared call sites, orders for observed flows.
Some rows break a rule on purpose, so that validation has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 16 digits of a digest of text x, as each engine spells it.
_DIGEST = {"spark": "substring(sha2({x}, 256), 1, 16)", "duckdb": "substr(sha256({x}), 1, 16)"}
_UNIT = "chr(31)"

_EVENTS = """
SELECT row_no, module, operation, host_id, port, path_template, provider_ref, byte_size_estimate, target_unresolved, field_path, call_site_path,
  CASE WHEN row_no % 89 = 5 THEN 'ee_0000000000000000' WHEN row_no % 101 = 7 THEN 'ee_XYZ' ELSE 'ee_' || {id} END AS egress_event_id
FROM (
  SELECT event_id AS row_no, 'm' || CAST(user_id % 5 AS STRING) AS module,
    CASE WHEN event_id % 97 = 11 THEN 'Bad-Op' ELSE event_type END AS operation,
    CASE WHEN event_id % 53 = 3 THEN 'unknown' ELSE 'h' || CAST((user_id % 19) * 2 AS STRING) || '.example' END AS host_id,
    CASE WHEN user_id % 3 = 1 THEN 8443 ELSE NULL END AS port,
    '/v1/' || CAST(event_id % 50 AS STRING) AS path_template,
    CASE WHEN event_id % 73 = 1 THEN 'P 1' WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'p' || CAST(user_id % 7 AS STRING) END AS provider_ref,
    CASE WHEN event_id % 29 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS byte_size_estimate,
    event_id % 11 = 0 AS target_unresolved,
    CASE WHEN event_id % 83 = 2 THEN 'messages[].content=secret' ELSE 'messages[].content' END AS field_path,
    CASE WHEN event_id % 79 = 4 THEN '/srv/app/main.py' WHEN event_id % 79 = 5 THEN 'C:/app.py' ELSE 'app/main.py' END AS call_site_path
  FROM {events}) raw
"""

_POINTS = """
SELECT 'ep_' || lpad(CAST(s_suppkey AS STRING), 16, '0') AS ep_id,
  CASE s_suppkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 4 THEN 'signup' WHEN 5 THEN 'never.called' ELSE NULL END AS operation,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE 'h' || CAST(s_suppkey % 41 AS STRING) || '.example' END AS host,
  CASE WHEN s_suppkey % 9 <> 8 AND s_suppkey % 10 = 4 THEN 8443 ELSE NULL END AS port,
  'p' || CAST(s_nationkey % 7 + CASE WHEN s_suppkey % 2 = 1 THEN 20 ELSE 0 END AS STRING) AS provider_ref,
  'src/f' || CAST(s_suppkey AS STRING) || '.py' AS path
FROM {supplier}
"""

_FLOWS = """
SELECT 'fl_' || lpad(CAST(o_orderkey AS STRING), 16, '0') AS flow_id,
  1700000000 + (o_orderkey * 7919) % 4000 AS t_start_bucket, (o_orderkey % 7) * 400 AS duration_ms,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'h' || CAST(o_custkey % 60 AS STRING) || '.example' END AS resolved_host,
  '10.0.0.' || CAST(o_orderkey % 20 AS STRING) AS dst_ip,
  CASE WHEN o_custkey % 3 = 1 THEN 8443 ELSE 443 END AS dst_port,
  o_custkey % 4 AS pid, CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE 1699990000 + o_custkey % 4 END AS pid_start_time,
  CASE o_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'node' ELSE 'curl' END AS comm,
  CASE o_orderstatus WHEN 'F' THEN 'out_of_scope_process' WHEN 'O' THEN 'in_scope' ELSE 'known_benign' END AS flow_scope,
  CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'unattributed' WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'inferred' ELSE 'kernel_attributed' END AS process_attribution,
  CASE WHEN o_custkey % 7 = 0 THEN 'unknown' ELSE 'p' || CAST(o_custkey % 7 + 40 AS STRING) END AS provider_ref,
  CASE WHEN o_orderkey % 8 = 0 AND o_custkey % 7 = 0 THEN 'opaque' WHEN o_custkey % 7 = 0 THEN 'unclassified' ELSE 'classified' END AS classification,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 4000 END AS bytes_out
FROM {orders}
"""


def _filled(text: str, engine: str, **tables: str) -> str:
    parts = f" || {_UNIT} || ".join(["'ee/v1'", "module", "operation", "host_id", "path_template"])
    return text.format(id=_DIGEST[engine].format(x=parts), **tables) if "{id}" in text else text.format(**tables)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_filled(_EVENTS, "spark", events="{src}"), src=spark.read.parquet(f"{sf_dir}/events.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_filled(_POINTS, "spark", supplier="{src}"), src=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_filled(_FLOWS, "spark", orders="{src}"), src=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def oracle_views() -> str:
    """The same tables as DuckDB's common table expressions raw_event, point and flow."""
    return f"raw_event AS ({_filled(_EVENTS, 'duckdb', events='events')}),\npoint AS ({_filled(_POINTS, 'duckdb', supplier='supplier')}),\nflow AS ({_filled(_FLOWS, 'duckdb', orders='orders')})"
