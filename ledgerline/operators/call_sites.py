"""Declared egress points from call sites: a syntax walk for Python sources, and joins with rules for any."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import identity as I
from ledgerline.functions import targets as T

STANDARD = sorted(sys.stdlib_module_names)
_CALLS = "path string, binding string, method string, receiver string, symbol string, start int, stop int, url string, contested boolean, speculative boolean"
_IMPORTS = "path string, module string"


def _dotted(node: ast.AST) -> list[str] | None:
    names: list[str] = []
    while isinstance(node, ast.Attribute | ast.Call):
        if isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        else:
            node = node.func
    return [node.id, *reversed(names)] if isinstance(node, ast.Name) else None


def _imports(tree: ast.AST) -> Iterator[tuple[str, str]]:
    """(local name, dotted path); a wildcard has the name *."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield (a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            for a in node.names:
                yield (a.asname or a.name, node.module if a.name == "*" else f"{node.module}.{a.name}") if a.name != "*" else ("*", node.module)


def python_calls(path: str, source: str) -> list[tuple]:
    """Calls of one Python file whose receiver leads to an import, with what they are bound to."""
    tree = ast.parse(source)
    bound: dict[str, set[str]] = {}
    wild = [p for n, p in _imports(tree) if n == "*"]
    for name, target in _imports(tree):
        if name != "*":
            bound.setdefault(name, set()).add(target)
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and (made := _dotted(node.value)):
            for target in node.targets:
                name = target.id if isinstance(target, ast.Name) else f"self.{target.attr}" if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" else None
                for of in bound.get(made[0], ()) if name else ():
                    bound.setdefault(name, set()).add(".".join([of, *made[1:]]))
    out = []

    def visit(node: ast.AST, symbol: str) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            symbol = f"{symbol}.{node.name}" if symbol else node.name
        if isinstance(node, ast.Call) and (names := _dotted(node.func)):
            root = f"self.{names[1]}" if names[0] == "self" and len(names) > 1 else names[0]
            rest = names[2:] if root.startswith("self.") else names[1:]
            guess = not bound.get(root) and len(wild) == 1 and root not in dir(__builtins__)
            paths = bound.get(root) or ({f"{wild[0]}.{root}"} if guess else set())
            url = next((a.value for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Constant) and isinstance(a.value, str) and "://" in a.value), None)
            if paths:
                out.append((path, sorted(paths)[0], rest[-1] if rest else root, ".".join(names[:-1]), symbol, node.lineno, node.end_lineno, url, len(paths) > 1, guess))
        for child in ast.iter_child_nodes(node):
            visit(child, symbol)

    visit(tree, "")
    return out


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, imports) of files (path, language, source): Python only; a file that doesn't parse has none."""

    def run(batches: Iterator[pd.DataFrame], what: str) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["source"], strict=True):
                try:
                    rows += python_calls(path, source) if what == "calls" else [(path, p) for _, p in _imports(ast.parse(source))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (_CALLS if what == "calls" else _IMPORTS).split(", ")])

    python = files.filter("language = 'python' and source is not null").select("path", "source")
    return python.mapInPandas(lambda b: run(b, "calls"), _CALLS), python.mapInPandas(lambda b: run(b, "imports"), _IMPORTS)


def matched(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Call sites of calls by rules (rule_id, module, symbols, methods, provider_ref, egress_kind, confidence): the binding starts with the module, segment by segment."""
    head = F.split("binding", r"\.")[0]
    of = rules.withColumn("head", F.split("module", r"\.")[0])
    met = calls.withColumn("head", head).join(of, "head")
    inside = (F.col("binding") == F.col("module")) | F.col("binding").startswith(F.concat(F.col("module"), F.lit(".")))
    named = (F.size("symbols") == 0) | F.arrays_overlap(F.split("binding", r"\."), F.col("symbols"))
    method = (F.size("methods") == 0) | F.array_contains("methods", F.col("method"))
    return met.filter(inside & named & method).drop("head")


def with_constructor(calls: DataFrame, writes: DataFrame) -> DataFrame:
    """calls (path, scope, receiver, start, ...) with constructor: the arguments that the receiver was last made with.

    writes (path, scope, variable, start, arguments) are the constructor calls that are assigned to variables. It is an as-of join: of
    the writes of the variable in the same scope, the last before the call counts; one at the same place
    comes after the call's own reading, and so does not. A scope of a file is put in order, never more.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in calls.columns)).alias("call")
    asked = calls.select("path", "scope", F.col("receiver").alias("variable"), "start", own)
    made = writes.select("path", "scope", "variable", "start", F.struct("arguments").alias("made"))
    line = Window.partitionBy("path", "scope", "variable").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    # Of writes that stand at one place, the greatest arguments count, so that reruns agree.
    met = made.groupBy("path", "scope", "variable", "start").agg(F.max("made").alias("made")).unionByName(asked, allowMissingColumns=True)
    last = F.max(F.when(F.col("made").isNotNull(), F.struct("start", "made"))).over(line)
    return met.withColumn("last", last).filter("call is not null").select("call.*", F.col("last.made.arguments").alias("constructor"))


def declared_points(sites: DataFrame) -> DataFrame:
    """Points of call sites: ep_id by path, symbol, shape and occurrence; lines take no part in it. Unsure bindings weaken a finding."""
    shape = F.concat_ws("/", "egress_kind", "method", "module")
    order = Window.partitionBy("path", "symbol", "shape").orderBy("start", "stop", "rule_id")
    found = sites.withColumn("shape", shape).withColumn("occurrence", F.row_number().over(order) - 1).withColumn("t", T.parse_target(F.col("url")))
    spelled = F.lower(F.concat_ws(".", F.array_except(F.split("receiver", r"\."), F.array(F.lit("self"))).cast("array<string>"), F.col("method")))
    weak = F.col("contested") | F.col("speculative")
    return found.select(
        I.identity("ep_", "ep/v1", F.col("path"), F.col("symbol"), F.col("shape"), F.col("occurrence")).alias("ep_id"),
        F.when(spelled.rlike("^[a-z][a-z0-9_.]*$"), spelled).alias("operation"),
        F.col("t.host").alias("host"),
        F.col("t.port").alias("port"),
        "provider_ref",
        "egress_kind",
        F.when(weak, "suspect").otherwise(F.col("confidence")).alias("confidence"),
        "path",
        "symbol",
        F.col("start").alias("line"),
        "rule_id",
    )


def unclaimed_imports(imports: DataFrame, first_party: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, module) of imports that are neither the project's own, nor standard, nor covered by a rule's module."""
    top = imports.withColumn("top", F.split("module", r"\.")[0]).distinct()
    standard = imports.sparkSession.createDataFrame([(m,) for m in STANDARD], "top string")
    left = top.join(F.broadcast(standard), "top", "left_anti").join(first_party.select(F.col("module").alias("top")).distinct(), "top", "left_anti")
    heads = rules.select(F.col("module").alias("covered"), F.split("module", r"\.")[0].alias("top")).distinct()
    covers = left.join(heads, "top").filter((F.col("module") == F.col("covered")) | F.col("module").startswith(F.concat(F.col("covered"), F.lit(".")))).select("path", "module").distinct()
    return left.join(covers, ["path", "module"], "left_anti").select("path", "module")
