"""Detector rules, scan policies and mask policies from TOML: small files that the driver reads and checks."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.derive import Settings
from ledgerline.operators.detect import fold
from ledgerline.operators.dictionary import Affixes
from ledgerline.operators.mask import MODES, Rule
from ledgerline.operators.report import Policy

DEPTH = 8
RULE_ID = re.compile(r"[a-z]+\.[a-z0-9_-]+\.[a-z0-9_-]+")
VERSION = re.compile(r"\d+\.\d+\.\d+")
#: The rule hits of a run whose rules or whose policy did not load.
RULE_SET_GATE, POLICY_GATE = "engine.rule-set-loaded", "engine.policy-loaded"


class Refused(ValueError):
    """A file that can't be used, and why."""


def rule_faults(rule: dict[str, Any]) -> list[str]:
    """What is wrong with one detector rule."""
    out = []
    if not RULE_ID.fullmatch(str(rule.get("id", ""))):
        out.append("id must be language.source.name")
    if not VERSION.fullmatch(str(rule.get("version", ""))):
        out.append("version must have three parts")
    matches = rule.get("match") or []
    if not matches:
        out.append("at least one match is needed")
    for m in matches:
        if not str(m.get("query", "")).strip():
            out.append("a match needs a query")
        if sum(x.get("role") == "destination" for x in m.get("extract", [])) > 1:
            out.append("one destination at most")
    return out


def load_rules(directory: str, skipped: tuple[str, ...] = ("masking",)) -> tuple[list[dict[str, Any]], list[str]]:
    """Rules of a directory's TOML files in path order, and faults; a bad rule is told and skipped, none at all is refused."""
    root, good, faults = Path(directory), [], []
    for path in sorted(root.rglob("*.toml")):
        parts = path.relative_to(root).parts
        if len(parts) > DEPTH or set(parts[:-1]) & set(skipped):
            continue
        try:
            rule = tomllib.loads(path.read_text())
        except (tomllib.TOMLDecodeError, UnicodeDecodeError, OSError) as error:
            faults.append(f"{path.name}: {error}")
            continue
        found = rule_faults(rule)
        faults += [f"{path.name}: {f}" for f in found]
        good += [] if found else [rule]
    if not good:
        raise Refused("no rule could be loaded")
    return good, faults


def scan_policy(text: str) -> tuple[Settings, Policy]:
    """Reconciliation settings and limits of a policy in TOML."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise Refused(str(error)) from error
    own = raw.get("reconciliation", {})
    band = own.get("volume_band")
    limits = raw.get("limits", {})
    settings = Settings(window_ms=own.get("window_ms", Settings.window_ms), band=(band["min_basis_points"], band["max_basis_points"]) if band else None, join_tolerance_ms=own.get("join_tolerance_ms", 250))
    return settings, Policy(limits.get("confirmed_fail"), limits.get("suspect_warn", 1), limits.get("unparsed_warn"))


MASK_KEYS = {"policy_id", "policy_version", "default", "rule", "alias_style", "date_policy", "on_hold_timeout", "code_block_policy", "tool_call_policy", "detection", "stream", "dictionary", "affix_rules"}


def mask_policy(text: str, pinned: str | None = None) -> tuple[str, list[Rule], str]:
    """Default mode, rules and hash of a mask policy in TOML; unknown keys, modes and another hash than the pinned one are refused."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise Refused(str(error)) from error
    if unknown := set(raw) - MASK_KEYS:
        raise Refused(f"unknown keys: {', '.join(sorted(unknown))}")
    own = hashlib.sha256(json.dumps(raw, sort_keys=True).encode()).hexdigest()
    if pinned and pinned != own:
        raise Refused("the policy isn't the pinned one")
    rules = [Rule(r["mode"], scope_path(r.get("scope", "")), r.get("entity")) for r in raw.get("rule", [])]
    default = raw.get("default", {}).get("mode", "mask")
    if bad := {default, *(r.mode for r in rules)} - set(MODES):
        raise Refused(f"unknown modes: {', '.join(sorted(bad))}")
    return default, rules, own


#: Entity types that a word list may claim.
LISTED = ("PERSON", "ORG", "LOC", "ADDRESS", "HOST")
#: Signs that may stand between a word and its suffix.
APOSTROPHES = "'’ʼ"


def _versioned(text: str) -> dict[str, Any]:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise Refused(str(error)) from error
    if not str(raw.get("schema_version", "")).startswith("1."):
        raise Refused(f"schema_version {raw.get('schema_version')} is not supported")
    return raw


def dictionary(spark: SparkSession, text: str) -> DataFrame:
    """Entries (value, entity) of a word list in TOML; empty values, and types that a word list may not claim, are refused."""
    raw = _versioned(text)
    if not raw.get("dictionary_id"):
        raise Refused("dictionary_id is empty")
    rows = [(str(e.get("value", "")), str(e.get("type", ""))) for e in raw.get("entries", [])]
    for k, (value, entity) in enumerate(rows):
        if not value.strip():
            raise Refused(f"entry {k} has no value")
        if entity not in LISTED:
            raise Refused(f"entry {k} has the type {entity}, which isn't a word list's")
    return spark.createDataFrame(rows, "value string, entity string")


def affixes(language: str, text: str) -> Affixes:
    """Affix rules of a language in TOML; without suffixes or apostrophes they would hide words, so such files are refused."""
    raw = _versioned(text)
    if raw.get("language") != language:
        raise Refused(f"the file is of language {raw.get('language')}")
    suffixes, marks = [fold(s) for s in raw.get("suffixes", [])], raw.get("apostrophes", [])
    if not suffixes or not all(suffixes):
        raise Refused("the suffixes are empty")
    if not marks or any(m not in APOSTROPHES or len(m) != 1 for m in marks):
        raise Refused("the apostrophes are empty or unknown")
    return Affixes(tuple(suffixes), "".join(marks), int(raw.get("min_base_chars", 3)), int(raw.get("max_affix_chain", 3)))


def rule_set_hash(rules: list[dict[str, Any]]) -> str:
    """The digest of a rule set, whatever the order of its files and keys."""
    return hashlib.sha256(json.dumps(sorted(json.dumps(r, sort_keys=True) for r in rules)).encode()).hexdigest()


def scope_path(text: str) -> tuple[str, ...]:
    """messages[*].content as its steps."""
    return tuple(re.findall(r"\[\*\]|\[\d+\]|[^.\[\]]+", text))


def gate_hits(spark: SparkSession, rule_faults: list[str], policy_refused: bool) -> DataFrame:
    """Rule hits (rule_id, verdict, finding_ids) that keep a run from passing when its rules or its policy did not load; none else."""
    hits = [(RULE_SET_GATE, "FAIL", None)] * bool(rule_faults) + [(POLICY_GATE, "FAIL", None)] * policy_refused
    return spark.createDataFrame(hits, "rule_id string, verdict string, finding_ids array<string>")
