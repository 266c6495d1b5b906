"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ann, common, decontaminate, html_extract, importance, license_scan, mixing, near_dup, periodic, secret_scan, sharding, token_counts, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]


#: The shards that documents are placed on.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents"), SHARDS)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (plan["copies"] * plan["size"]).alias("taken"), "source", "copies")


def op6_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_rules.judged(pages, url_rules.mine(pages, _table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call begins with an empty cache of its own, so that it encodes all there is to encode."""
    cache = f"{common.shared_dir(spark).rstrip('/')}/ledgerline/token-cache-{uuid.uuid4().hex}"
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, in which some ids (a tenth, by their CRC-32) repeat a stretch of words to the end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p)
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), times.cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    ahead = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_benchmark_decontamination,
        op3_toxicity,
        op4_html_extraction,
        op5_sharding,
        op6_hnsw_nearest,
        op7_url_rules,
        op8_minhash_near_dedup,
        op9_mixing_sources,
        op10_secret_scan,
        op11_token_counts,
        op12_importance_resampling,
        op13_periodic_runs,
    )
}

ORACLE: dict[str, str] = {}

#: Links by counting shared 3-word shingles, then reachability; words and lower-casing as the operator has them.
ORACLE["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT u AS s, u AS t FROM edge UNION SELECT r.s, e.v FROM reach r JOIN edge e ON e.u = r.t),
comp AS (SELECT s, min(t) AS c FROM reach GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.s = d.doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE["op2_benchmark_decontamination"] = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM i WHERE len(ws) > 0),
ig AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' ')))) AS gram FROM iw),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k),
dg AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' ')))) AS gram FROM dk),
m AS (SELECT doc_id, item_id, count(DISTINCT gram) AS n_shared FROM dg JOIN ig USING (k, gram) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_item, n_shared / n AS containment FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n
"""

#: Targets by filling sources in order of their limit for a unit of weight, then systematic sampling in the operator's order.
ORACLE["op9_mixing_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS pos FROM s),
f AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest2,
    sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow FROM o),
cut AS (SELECT min(pos) AS pos FROM f WHERE w * rest2 <= 4 * source_size * ow),
t AS (
  SELECT f.source, f.source_size, CASE WHEN f.pos < cut.pos THEN 2.0 * f.source_size ELSE (f.w * c.rest2)::DOUBLE / (2 * c.ow)::DOUBLE END AS target,
    ('0x' || substr(md5('mix:' || coalesce(f.source, 'None')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM f, cut JOIN f c ON c.pos = cut.pos),
r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size::DOUBLE)),
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % greatest(1, (SELECT count(*) FROM d) // 20000), size, doc_id NULLS FIRST) AS k FROM d),
c AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate, t.u FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM x
"""


def _secret_kind(number: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT row, {number} AS kind, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(m) AS n, m, part, {keep} AS ok
FROM (SELECT row, unnest(ms) AS m, unnest(parts) AS part, unnest(gaps[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
  FROM (SELECT row, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS gaps FROM d)) WINDOW w AS (PARTITION BY row ORDER BY i)"""


_KINDS = [
    _secret_kind(0, secret_scan.BASE["assign"][0], 2, "length(part) >= 12"),
    _secret_kind(1, secret_scan.BASE["access"][0], 0, "length(m) >= 18"),
    _secret_kind(2, "[0-9a-f]{16,}", 0, "true"),
    _secret_kind(3, secret_scan.WEAK["account"][0], 2, "length(part) >= 3"),
    _secret_kind(4, "[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
    _secret_kind(5, secret_scan.WEAK["endpoint"][0], 0, "length(m) >= 8"),
    _secret_kind(9, r"\n[\x20\x09\x0D]*\n\s*", 0, "true"),
]
ORACLE["op10_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(f'SELECT row, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({k}) WHERE ok' for k in _KINDS)}),
p AS (SELECT row, kind, s, e, (SELECT count(*) FROM f b WHERE b.row = f.row AND b.kind = 9 AND b.e <= f.s) AS scope FROM f WHERE kind < 9),
j AS (SELECT w.row, w.kind, w.s, w.e, o.kind AS k2, o.e <= w.s OR w.e <= o.s AS apart FROM p w JOIN p o ON w.row = o.row AND w.scope = o.scope AND (w.s <> o.s OR w.kind <> o.kind) WHERE w.kind >= 3),
r AS (SELECT row, kind, s, e, bool_or(k2 IN (1, 3) AND apart) AS name, bool_or(k2 IN (0, 2, 4) AND apart) AS secret, bool_or(k2 = 5 AND apart) AS endpoint, bool_or(NOT apart AND k2 < kind) AS covered FROM j GROUP BY ALL),
x AS (SELECT row, kind, s, e FROM p WHERE kind < 3 UNION ALL SELECT row, kind, s, e FROM r WHERE NOT covered AND CASE kind WHEN 3 THEN secret WHEN 4 THEN name OR (endpoint AND secret) ELSE name AND secret END),
t AS (SELECT *, ['assign', 'access', 'hex', 'account', 'opaque', 'endpoint'][kind + 1] || ':' || s::VARCHAR || ':' || e::VARCHAR AS span FROM x)
SELECT d.doc_id, count(*) FILTER (t.kind = 0) AS n_assign, count(*) FILTER (t.kind = 1) AS n_access, count(*) FILTER (t.kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN t USING (row) GROUP BY d.row, d.doc_id
"""


def _values(rows: list[tuple]) -> str:
    show = lambda x: "[" + ", ".join(map(show, x)) + "]" if isinstance(x, tuple) else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_TEMPLATES = license_scan.templates()
_POSTS = [(w, t.no, i) for t in _TEMPLATES for i, w in enumerate(t.words) if w not in license_scan.PLAIN]
_SHAPES = [(t.no, t.label, t.base, t.key_at, t.key, len({w for w in t.words if w not in license_scan.PLAIN}), len(t.anchors)) for t in _TEMPLATES]
#: Every place where a key phrase stands, and the share of the template's rare words around it.
ORACLE["op1_license_scan"] = f"""
WITH post AS (SELECT * FROM (VALUES {_values(_POSTS)}) v(word, template, at_)), shape AS (SELECT * FROM (VALUES {_values(_SHAPES)}) v(template, label, base, key_at, key, rare, need)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT row, word, pos FROM (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM post)),
vote AS (SELECT row, template, pos - at_ AS start, count(*) AS votes FROM pos JOIN post USING (word) GROUP BY ALL),
hit AS (SELECT row, label, base, start + key_at AS begin, CASE WHEN base THEN 1.0 ELSE least(1.0, greatest(votes, need) / rare) END AS share
  FROM vote JOIN shape USING (template) JOIN d USING (row) WHERE start + key_at >= 0 AND start + key_at + len(key) <= len(ws) AND ws[start + key_at + 1:start + key_at + len(key)] = key),
agg AS (SELECT row, count(*) FILTER (base) AS n_base, min(begin) FILTER (base) AS first_word, max(begin) FILTER (base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score FROM hit GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN agg USING (row)
"""

#: The slot by md5, and the shard from the filled table, whose filling tests/llm compares with brute force.
ORACLE["op5_sharding"] = f"""
WITH d AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents),
l AS (SELECT string_split('{",".join(map(str, sharding.fill_table(SHARDS)))}', ',') AS owners),
t AS (SELECT generate_subscripts(owners, 1) - 1 AS slot, unnest(owners) AS owner FROM l)
SELECT doc_id, text, lang, source, n_chars, slot, 'shard-' || lpad(owner, 3, '0') AS shard FROM d JOIN t USING (slot)
"""


def _crc32(blob: str) -> str:
    """The CRC-32 of a blob, byte by byte, each looked up in the table of the polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = f"list_transform(range(1, 2 * octet_length({blob}) + 1, 2), lambda i: ('0x' || hex({blob})[i:i + 1])::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {digits}, lambda c, b: xor(c >> 8, ({table}::BIGINT[])[xor(c, b) % 256 + 1])))"


#: Weights and scores in the order of the contract; a bucket of a word is made once for each distinct word.
ORACLE["op12_importance_resampling"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
o AS (SELECT row, unnest(ws) AS word FROM d),
b AS (SELECT unnest(ws) AS word FROM (SELECT {_WORDS} AS ws FROM benchmark)),
v AS (SELECT word, {_crc32("encode(word)")} % 10000 AS bucket FROM (SELECT word FROM o UNION SELECT word FROM b)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM o) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM o JOIN v USING (word) JOIN g USING (bucket) GROUP BY row),
x AS (SELECT row, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (row)
"""

#: A run of exponent 4 has four equal words in a row at multiples of its period: these are looked for, then the stretch is measured.
ORACLE["op13_periodic_runs"] = f"""
WITH d0 AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {_crc32("encode(doc_id::VARCHAR)")} AS h FROM documents),
d1 AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d1),
d AS (SELECT row, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM d2),
q AS (SELECT row, unnest(range(1, n // 4 + 1)) AS q FROM d),
c AS (SELECT row, q, ws, n FROM q JOIN d USING (row)
  WHERE len(list_filter(range(0, (n - 1) // q - 2), lambda k: ws[k * q + 1] = ws[(k + 1) * q + 1] AND ws[k * q + 1] = ws[(k + 2) * q + 1] AND ws[k * q + 1] = ws[(k + 3) * q + 1])) > 0),
e AS (SELECT row, q, unnest(list_filter(range(0, n - q), lambda i: ws[i + 1] = ws[i + q + 1])) AS i FROM c),
f AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM e),
s AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM f GROUP BY row, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT row, start, length, min(q) AS period FROM s GROUP BY row, start, length),
l AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY row),
m AS (SELECT a.row, a.start, a.length, a.period FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.row = a.row AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))),
g AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d) w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.row = w.row AND g.i = w.i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (row) LEFT JOIN m USING (row) LEFT JOIN k USING (row)
"""
