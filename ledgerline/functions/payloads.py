"""JSON payloads: text leaves with their paths, rewriting, field paths and size estimates."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Bounds of a shape walk, and what values count as.
DEPTH, ITEMS, PATHS = 6, 16, 128
SCALAR_BYTES, NULL_BYTES = 8, 4
DYNAMIC = "<dyn>"
#: Keys whose names may be told: lower-case words of an API's vocabulary.
KEY_SHAPE = regex.compile(r"[a-z][a-z0-9_]{0,39}")


def text_leaves(value: Any, path: tuple[str, ...] = (), nested: bool = True) -> list[tuple[str, str]]:
    """(path, text) of every string leaf; a string that is itself an object or array is told, then walked once at its path."""
    out: list[tuple[str, str]] = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += text_leaves(v, (*path, k), nested)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += text_leaves(v, (*path, f"[{i}]"), nested)
    elif isinstance(value, str):
        out.append((".".join(path).replace(".[", "["), value))
        if nested and value[:1] in "{[":
            inner = parsed(value)
            if isinstance(inner, dict | list):
                out += text_leaves(inner, path, False)
    return out


def parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def rewrite(value: Any, change: Callable[[str, tuple[str, ...]], str], path: tuple[str, ...] = (), nested: bool = True) -> Any:
    """The value with every string leaf changed: a carrier of JSON first as text, then leaf by leaf inside. Keys stay."""
    if isinstance(value, dict):
        return {k: rewrite(v, change, (*path, k), nested) for k, v in value.items()}
    if isinstance(value, list):
        return [rewrite(v, change, (*path, f"[{i}]"), nested) for i, v in enumerate(value)]
    if isinstance(value, str):
        done = change(value, path)
        inner = parsed(done) if nested and done[:1] in ("{", "[") else None
        if isinstance(inner, dict | list):
            return json.dumps(rewrite(inner, change, path, False), ensure_ascii=False, separators=(",", ":"))
        return done
    return value


class _Walk:
    def __init__(self, allowed: set[str] | None) -> None:
        self.allowed, self.paths, self.size, self.stopped = allowed, set(), 0, None

    def key(self, name: str) -> str:
        known = name in self.allowed if self.allowed is not None else bool(KEY_SHAPE.fullmatch(name))
        return name if known else DYNAMIC

    def stop(self, depth: int) -> None:
        self.stopped = depth if self.stopped is None else min(self.stopped, depth)

    def tell(self, path: str) -> None:
        if path and len(self.paths) < PATHS:
            self.paths.add(path)

    def go(self, value: Any, path: str, depth: int) -> None:
        if len(self.paths) >= PATHS or depth > DEPTH:
            self.tell(path)
            self.stop(depth)
        elif isinstance(value, dict):
            if not value:
                self.tell(path)
            for k, v in value.items():
                self.go(v, f"{path}.{self.key(k)}" if path else self.key(k), depth + 1)
        elif isinstance(value, list):
            child, before = f"{path}[]", self.size
            if not value:
                self.tell(child)
            for v in value[:ITEMS]:
                self.go(v, child, depth + 1)
            if len(value) > ITEMS:
                self.size = before + (self.size - before) * len(value) // ITEMS
                self.stop(depth + 1)
        else:
            self.tell(path)
            self.size += NULL_BYTES if value is None else len(value) if isinstance(value, str) else SCALAR_BYTES


def shape(value: Any, allowed: set[str] | None = None) -> tuple[list[str], int, int | None]:
    """Sorted field paths, estimated bytes, and the depth at which the walk stopped, if it did."""
    walk = _Walk(allowed)
    if isinstance(value, dict | list):
        walk.go(value, "", 0)
    else:
        walk.stop(0)
    return sorted(walk.paths), walk.size, walk.stopped


SHAPE = StructType([StructField("field_paths", ArrayType(StringType())), StructField("byte_size_estimate", LongType()), StructField("truncated_depth", IntegerType())])


@F.pandas_udf(SHAPE)
def payload_shape(bodies: pd.Series) -> pd.DataFrame:
    """The shape of JSON texts; a text that isn't JSON has none."""
    rows = [shape(parsed(b)) for b in bodies]
    return pd.DataFrame({"field_paths": [r[0] for r in rows], "byte_size_estimate": [r[1] for r in rows], "truncated_depth": pd.array([r[2] for r in rows], dtype="Int32")})


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("text", StringType())])))
def leaves(bodies: pd.Series) -> pd.Series:
    """Text leaves of JSON texts."""
    return bodies.map(lambda b: [{"path": p, "text": t} for p, t in text_leaves(parsed(b))])
