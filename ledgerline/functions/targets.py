"""Destinations: parsing, comparison, path templates, providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "unknown"
#: Ports that a scheme implies and that are left out of a target.
DEFAULT_PORTS = (80, 443)

#: Host to provider, by exact host, by suffix and by pattern.
EXACT_HOSTS = {
    "api.openai.com": "openai",
    "api.anthropic.com": "anthropic",
    "generativelanguage.googleapis.com": "google-gemini",
    "api.mistral.ai": "mistral",
    "api.cohere.ai": "cohere",
    "api.cohere.com": "cohere",
    "api.groq.com": "groq",
    "api.deepseek.com": "deepseek",
    "api.together.xyz": "together",
    "openrouter.ai": "openrouter",
}
SUFFIX_HOSTS = {
    ".openai.azure.com": "azure-openai",
    ".cognitiveservices.azure.com": "azure-cognitive",
    "-aiplatform.googleapis.com": "google-vertex",
    ".huggingface.co": "huggingface",
    ".pinecone.io": "pinecone",
    ".weaviate.network": "weaviate",
    ".qdrant.io": "qdrant",
}
PATTERN_HOSTS = {r"^bedrock(-runtime)?\.[a-z0-9-]+\.amazonaws\.com$": "aws-bedrock"}

#: Path segments that name one thing rather than a place.
IDENTIFIER_SEGMENTS = [
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-",
    r"^[0-9a-fA-F]{16,}$",
    r"^[A-Za-z0-9_-]{20,}$",
    r"^[A-Za-z]+[-_](?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{8,}$",
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _authority(text: Column) -> Column:
    """What is left of a destination without scheme, path, query, fragment and user."""
    bare = F.trim(text)
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    return F.regexp_replace(bare, r"^.*@", "")


def parse_target(text: Column) -> Column:
    """struct<host, port> of a destination as written; null if no host is left.

    More than one colon outside brackets, or a port that isn't a number below 65536, makes the whole a
    host. Trailing dots go, ASCII letters are lower-cased, and ports 80 and 443 are left out.
    """
    parsed = F.transform(F.array(_authority(text)), _split_authority)[0]
    return F.when(text.isNotNull() & (parsed["host"] != ""), parsed)


def _split_authority(whole: Column) -> Column:
    bracket_host = F.regexp_extract(whole, r"^\[([^\]]*)\]", 1)
    port_text = F.regexp_extract(whole, r"^(?:\[[^\]]*\]|[^:]*):([0-9]{1,5})$", 1)
    number = F.when(port_text != "", port_text.cast("int"))
    fits = F.coalesce(number <= 65535, F.lit(False))
    host = F.when(bracket_host != "", bracket_host).when(fits, F.regexp_extract(whole, r"^([^:]*):", 1)).otherwise(whole)
    return F.struct(ascii_lower(F.regexp_replace(host, r"\.+$", "")).alias("host"), F.when(fits & ~number.isin(*DEFAULT_PORTS), number).alias("port"))


def normal_host(host: Column) -> Column:
    """A host that is already apart from its port, as targets spell it; null if empty."""
    low = ascii_lower(F.regexp_replace(F.trim(host), r"\.+$", ""))
    return F.when(low != "", low)


def normal_port(port: Column) -> Column:
    return F.when(~port.isin(*DEFAULT_PORTS), port.cast("int"))


def target_text(host: Column, port: Column) -> Column:
    return F.when(port.isNull(), host).otherwise(F.concat_ws(":", host, port.cast("string")))


def is_address(host: Column) -> Column:
    """A literal address: it holds a colon, or is four labels of digits, whatever their size."""
    return host.contains(":") | host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")


def shares_name(a: Column, b: Column) -> Column:
    """Whether one host is the other or a name below it."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def drift_kind(declared_host: Column, declared_port: Column, host: Column, port: Column) -> Column:
    """How an observed target departs from a declared one: the first that holds of address literal, port, subdomain, host."""
    return (
        F.when(is_address(host) & ~is_address(declared_host), "address_literal")
        .when(declared_host == host, "port")
        .when(shares_name(declared_host, host), "subdomain")
        .otherwise("host")
    )


def path_template(path: Column) -> Column:
    """The path with segments that name one thing replaced by {id}; an empty path is /."""
    one = lambda s: F.when(reduce(lambda a, b: a | b, (s.rlike(p) for p in IDENTIFIER_SEGMENTS)), F.lit("{id}")).otherwise(s)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(F.array_join(F.transform(F.split(path, "/"), one), "/"))


def provider_of(host: Column) -> Column:
    """The provider of a host by exact name, then suffix, then pattern; 'unknown' if none."""
    low = F.lower(host)
    exact = F.create_map(*(F.lit(x) for kv in EXACT_HOSTS.items() for x in kv))
    out = F.lit(UNKNOWN)
    for pattern, name in reversed(PATTERN_HOSTS.items()):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    for suffix, name in reversed(SUFFIX_HOSTS.items()):
        out = F.when(low.endswith(suffix), name).otherwise(out)
    return F.coalesce(F.element_at(exact, low), F.when(low.isNull() | (low == ""), F.lit(UNKNOWN)).otherwise(out))


def classify_hosts(rows: DataFrame, host: str, out: str = "provider_ref") -> DataFrame:
    """rows with the provider of their host."""
    return rows.withColumn(out, provider_of(F.col(host)))


def is_absolute_path(path: Column) -> Column:
    return path.rlike(r"^([/\\]|[A-Za-z]:)")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def target_block(url: Column) -> Column:
    """struct<host_id, port, path_template, provider_ref> of a request URL; the unresolved block if it has no host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    whole = _authority(F.when(scheme != "", url))
    host = ascii_lower(F.regexp_extract(whole, r"^(\[[^\]]*\]|[^:]*)", 1))
    stated = F.regexp_extract(whole, r":([0-9]{1,5})$", 1)
    port = F.when(stated != "", stated.cast("int")).when(scheme == "https", 443).when(scheme == "http", 80)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    known = F.struct(host.alias("host_id"), port.alias("port"), path_template(path).alias("path_template"), provider_of(host).alias("provider_ref"))
    unresolved = F.struct(F.lit(UNKNOWN).alias("host_id"), F.lit(None).cast("int").alias("port"), F.lit(None).cast("string").alias("path_template"), F.lit(UNKNOWN).alias("provider_ref"))
    return F.when(F.coalesce(host, F.lit("")) != "", known).otherwise(unresolved)
