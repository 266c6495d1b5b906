"""Content identities: a prefix and 16 hexadecimal digits of a digest over a tag and fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = 31


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C; only texts that aren't ASCII leave the JVM's answer to Python."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(_composed(text))


def digest(tag: str, *fields: Column) -> Column:
    """16 hexadecimal digits over the tag and the fields; a null field counts as empty."""
    parts = [F.lit(tag), *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)]
    return F.substring(F.sha2(F.concat_ws(chr(SEPARATOR), *parts), 256), 1, 16)


def identity(prefix: str, tag: str, *fields: Column) -> Column:
    return F.concat(F.lit(prefix), digest(tag, *fields))


def is_identity(prefix: str, value: Column) -> Column:
    return value.rlike(f"^{prefix}[0-9a-f]{{16}}$")


def event_identity(module: Column, operation: Column, host: Column, path_template: Column) -> Column:
    return identity("ee_", "ee/v1", module, operation, host, path_template)


def flow_identity(host: Column, boot: Column, src_port: Column, dst_ip: Column, dst_port: Column, proto: Column, bucket: Column) -> Column:
    tuple_text = F.concat_ws("/", src_port.cast("string"), dst_ip, dst_port.cast("string"), proto)
    return identity("fl_", "fl/v1", host, boot, tuple_text, bucket)


def finding_identity(kind: Column, source: Column, primary_ref: Column, rule: Column) -> Column:
    return identity("fnd_", "fi/v1", kind, source, primary_ref, rule)


def host_identity(stated: Column) -> Column:
    """An opaque name for a stated host."""
    return identity("h_", "host/v1", stated)
