"""Source trees as tables: which files are read, in what language, and why the others aren't."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ledgerline.functions.tables import maybe_broadcast, settle

LARGEST, SNIFFED = 2 << 20, 8192
#: Bytes and files that a task reads about.
TASK_BYTES, TASK_FILES = 32 << 20, 2_000
#: Directories that are never read, and languages by file suffix.
PRUNED = [".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "vendor", "venv", ".venv", "__pycache__", ".tox", ".mypy_cache", ".next"]
#: Ignore files, the weakest kind first.
IGNORE_FILES = [".gitignore", ".ignore", ".ledgerlineignore"]
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "go": "go", "java": "java"}


def pruned(path: Column) -> Column:
    names = "|".join(n.replace(".", r"\.") for n in PRUNED)
    return path.rlike(f"(^|/)({names})(/|$)")


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classified(files: DataFrame) -> DataFrame:
    """files (path, length, content) with language, state (parsed or unread), reason and content_hash."""
    head = F.substring(F.col("content"), 1, SNIFFED)
    reason = (
        F.when(F.col("content").isNull(), "io_error")
        .when(F.col("length") > LARGEST, "too_large")
        .when(F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) > 0, "binary")
        .when(language(F.col("path")).isNull(), "unknown_language")
        .when(~F.call_function("is_valid_utf8", F.col("content")), "io_error")
    )
    return files.withColumn("language", language(F.col("path"))).withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "parsed").otherwise("unread")).withColumn("content_hash", F.when(F.col("reason").isNull(), F.sha2("content", 256)))


def glob_regex(pattern: str) -> str:
    """A regular expression that a whole path below the rule file's folder matches where the pattern does; it has no ending slash any more."""
    body, out, i = pattern.strip("/") if pattern != "/" else pattern, [], 0
    while i < len(body):
        c, rest = body[i], body[i:]
        if rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rest == "**" and i and body[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += len(rest) - len(rest.lstrip("*"))
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            inner = "^/" + inner[1:] if inner[0] in "!^" else inner
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end + 1
        else:
            c = body[i + 1] if c == "\\" and i + 1 < len(body) else c
            out.append(c if c.isalnum() or c in "/_" else "\\" + c)
            i += 1 + (body[i] == "\\" and i + 1 < len(body))
    return ("" if "/" in pattern.rstrip("/") else "(?:.*/)?") + "".join(out)


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression, negated, for folders only) of a line of an ignore file; none for blanks and comments."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    return (glob_regex(text), negated, text.endswith("/")) if text.strip("/") else None


def ignore_rules(lines: DataFrame) -> DataFrame:
    """Rules of lines (dir: of the rule file, '' at the root; kind: its rank, line, text) of ignore files."""

    @F.pandas_udf("regex string, negated boolean, folders boolean")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ignore_rule(t) or (None, None, None) for t in texts], columns=["regex", "negated", "folders"])

    return lines.withColumn("rule", parsed(F.col("text"))).filter("rule.regex is not null").select("dir", "kind", "line", "rule.*")


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Of paths (path), those that rules ignore.

    Every path and every folder that it lies in meets the rules of all folders above it, by a join on the folder: of those that
    match, the one of the strongest kind of rule file decides, then of the deepest folder, then the last line. A
    path is left out if it or any folder above it is; so nothing below an ignored folder comes back.
    """
    part = F.split("path", "/")
    nodes = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(part))).alias("n"))
    nodes = nodes.select("path", F.array_join(F.slice(part, F.lit(1), F.col("n")), "/").alias("node"), (F.col("n") < F.size(part)).alias("folder"))
    own = F.split("node", "/")
    above = nodes.select("node", "folder").distinct().select("node", "folder", F.explode(F.sequence(F.lit(0), F.size(own) - 1)).alias("depth"))
    above = above.withColumn("dir", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(own, F.lit(1), F.col("depth")), "/")))
    below = F.when(F.col("depth") == 0, F.col("node")).otherwise(F.expr("substring(node, length(dir) + 2)"))
    hits = above.join(rules, "dir").filter((F.col("folder") | ~F.col("folders")) & F.regexp_like(below, F.concat(F.lit("^(?s:"), F.col("regex"), F.lit(")$"))))
    judged = hits.groupBy("node", "folder").agg(F.max_by("negated", F.struct("kind", "depth", "line")).alias("back")).filter("not back")
    return nodes.join(judged, ["node", "folder"], "left_semi").select("path").distinct()


@dataclass
class Files(InputPartition):
    """Files of a tree that one task reads."""

    paths: list[tuple[str, int]]


class TreeReader(DataSourceReader):
    """Lists a tree on the driver, as any file source does, and reads its files in tasks of a bounded size."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)
        return store, base.rstrip("/")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = self._store()
        local = isinstance(store, fs.LocalFileSystem)
        folders, tasks, held, size = [base], [], [], 0
        while folders:
            for entry in store.get_file_info(fs.FileSelector(folders.pop())):
                if local and os.path.islink(entry.path):
                    continue
                if entry.type == fs.FileType.Directory:
                    if entry.base_name not in PRUNED:
                        folders.append(entry.path)
                elif entry.type == fs.FileType.File:
                    held.append((entry.path[len(base) + 1 :], entry.size))
                    size += min(entry.size, LARGEST + 1)
                    if size >= TASK_BYTES or len(held) >= TASK_FILES:
                        tasks.append(Files(held))
                        held, size = [], 0
        return [*tasks, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple[str, int, bytes | None]]:
        store, base = self._store()
        for path, length in partition.paths:
            try:
                with store.open_input_stream(f"{base}/{path}") as f:
                    yield path, length, f.read(SNIFFED if length > LARGEST else length)
            except OSError:
                yield path, length, None


class TreeSource(DataSource):
    """Files of a tree, hidden ones too, without following links: path below the root, length, content (of those that are too large, the beginning)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"])


def read_tree(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """path (below root), length, content of a tree's files; pruned folders, what ignore files name, and ignored path patterns are left out."""
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("source_tree").option("path", root).load().filter(~pruned(F.col("path")))
    if ignored:
        rows = rows.filter(~F.col("path").rlike("|".join(f"(?:{p})" for p in ignored)))
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.array_position(F.array(*map(F.lit, IGNORE_FILES)), name)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    files = rows.filter(name.isin(IGNORE_FILES)).select(folder.alias("dir"), kind.alias("kind"), F.col("content").cast("string").alias("whole"))
    rules = settle(ignore_rules(files.select("dir", "kind", F.posexplode(F.split("whole", "\n")).alias("line", "text"))), "ignore-rules")
    return rows.join(ignored_paths(rows.select("path"), maybe_broadcast(rules)), "path", "left_anti")


def ignore_pattern(line: str) -> str | None:
    """A regular expression over paths for one line of an ignore file; null for blanks and comments."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    inner = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_" else "\\" + c) for c in text.strip("/").replace("**", "\x00")).replace("\\\x00", ".*")
    return ("^" if "/" in text.strip("/") or text.startswith("/") else "(^|/)") + inner + "(/|$)"
