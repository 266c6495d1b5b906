"""Masking: which spans are replaced, by what, and how they come back.

Aliases follow from a key, the value's type and its normal form, so a value has one alias within a key; a
session keeps which aliases it gave out, and only those are restored.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import checksums as K
from ledgerline.operators import detect as D

#: Parts that aliases are made of.
LABELS = ["example-a", "example-b", "example-c", "example-d", "example-e", "example-f", "example-g", "example-h"]
DOCUMENT_BLOCKS = ["203.0.113", "198.51.100", "192.0.2"]
TEST_CARDS = ["4242424242424242", "4000056655665556", "4111111111111111", "5555555555554444", "5105105105105100", "378282246310005", "371449635398431", "6011111111111117"]
ATTEMPTS = 32
MODES = ["allow", "mask", "block"]
LABELLED = {"PERSON", "ORG", "LOC", "ADDRESS"}
#: How strong an alias's claim to belong to nobody is, the weakest last.
RUNGS = ["reserved", "invalid", "label", "opaque"]
ALIAS_SHAPE = r"LGL_[A-Z0-9_]+_[0-9a-f]{16}|(?:PERSON|ORG|LOC|ADDRESS)_[0-9]+"


def normal(entity: str, value: str) -> str:
    """The form in which two spellings of one value agree."""
    bare = value.strip()
    if entity == "IBAN":
        return K.compact_iban(bare)
    if entity in ("TCKN", "VKN", "CREDIT_CARD"):
        return K.digits(bare)
    if entity == "PHONE":
        number = K.digits(bare)
        return "+" + number[2:] if number.startswith("00") else ("+" if bare.startswith("+") else "") + number
    if entity == "EMAIL":
        local, at, domain = bare.partition("@")
        return f"{local.lower()}{at}{domain.rstrip('.').lower()}"
    if entity in ("URL", "HOST"):
        return bare.rstrip(".").lower()
    if entity == "IPV6":
        return bare.lower()
    if entity in LABELLED:
        return " ".join(D.fold(bare).split())
    return bare


def seed(key: bytes, entity: str, value: str) -> bytes:
    tag = "HOST" if entity == "URL" else entity
    return hmac.new(key, tag.encode() + b"\x00" + normal(entity, value).encode(), hashlib.sha256).digest()


class _Stream:
    """Deterministic draws from a seed."""

    def __init__(self, key: bytes, of: bytes, attempt: int) -> None:
        own = hmac.new(key, b"ledgerline/render/v1" + of + attempt.to_bytes(4, "little"), hashlib.sha256).digest()
        self.bytes = b"".join(hmac.new(own, bytes([i]), hashlib.sha256).digest() for i in range(16))
        self.at = 0

    def below(self, n: int) -> int:
        out = 0
        for _ in range(4):
            out = out << 8 | self.bytes[self.at % len(self.bytes)]
            self.at += 1
        return out % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def hex(self, n: int) -> str:
        return "".join("0123456789abcdef"[self.below(16)] for _ in range(n))


def _opaque(entity: str, s: _Stream) -> tuple[str, str]:
    return f"LGL_{entity}_{s.hex(16)}", "opaque"


def render(entity: str, value: str, s: _Stream, label: int) -> tuple[str, str]:
    """An alias and its rung; numbers with check digits come out with wrong ones."""
    if entity in LABELLED:
        return f"{entity}_{label}", "label"
    if entity == "EMAIL":
        return f"user{s.digits(5)}@{LABELS[s.below(8)]}.invalid", "reserved"
    if entity in ("HOST", "URL"):
        return f"host{s.digits(3)}.{LABELS[s.below(8)]}.invalid", "reserved"
    if entity == "IPV4":
        return f"{DOCUMENT_BLOCKS[s.below(3)]}.{s.below(256)}", "reserved"
    if entity == "IPV6":
        return f"2001:db8:{s.hex(4)}:{s.hex(4)}::{s.hex(4)}", "reserved"
    if entity == "CREDIT_CARD":
        return TEST_CARDS[s.below(len(TEST_CARDS))], "reserved"
    if entity == "IBAN":
        bare = K.compact_iban(value)
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in bare[4:])
        right = K.iban_check_digits(bare[:2], body)
        return f"{bare[:2]}{(right - 2 + 1 + s.below(96)) % 97 + 2:02d}{body}", "invalid"
    if entity == "TCKN":
        nine = str(1 + s.below(9)) + s.digits(8)
        right = int(K.tckn_tail(nine))
        return f"{nine}{(right + 1 + s.below(99)) % 100:02d}", "invalid"
    if entity == "VKN":
        nine = s.digits(9)
        return f"{nine}{(int(K.vkn_tail(nine)) + 1 + s.below(9)) % 10}", "invalid"
    return _opaque(entity, s)


@dataclass
class Session:
    """The aliases of one session: given out, taken, and the numbers of labels."""

    key: bytes
    issued: dict[bytes, str] = field(default_factory=dict)
    originals: dict[str, str] = field(default_factory=dict)
    rungs: dict[str, str] = field(default_factory=dict)
    withheld: set[str] = field(default_factory=set)
    labels: dict[str, int] = field(default_factory=dict)

    def withhold(self, text: str) -> None:
        """Words that look like aliases are never given out."""
        self.withheld |= set(regex.findall(ALIAS_SHAPE, text))

    def mint(self, entity: str, value: str) -> tuple[str, bool]:
        """The value's alias, and whether it was given out before. The first spelling is the one that comes back."""
        of = seed(self.key, entity, value)
        if of in self.issued:
            return self.issued[of], True
        label = self.labels.get(entity, 1)
        for attempt in range(ATTEMPTS + 1):
            stream = _Stream(self.key, of, attempt)
            alias, rung = render(entity, value, stream, label + attempt) if attempt < ATTEMPTS else _opaque(entity, stream)
            if alias not in self.originals and alias not in self.withheld and alias != value:
                break
        else:
            raise ValueError(f"no free alias for a value of type {entity}")
        if entity in LABELLED:
            self.labels[entity] = label + attempt + 1
        self.issued[of], self.originals[alias], self.rungs[alias] = alias, value, rung
        return alias, False


@dataclass(frozen=True)
class Rule:
    """A mode for values under a path prefix (names, [*] or [n]) and, if stated, of one type."""

    mode: str
    scope: tuple[str, ...] = ()
    entity: str | None = None


def _covers(scope: tuple[str, ...], path: tuple[str, ...]) -> bool:
    return len(scope) <= len(path) and all(s == p or (s == "[*]" and p.startswith("[")) for s, p in zip(scope, path, strict=False))


def decide(rules: list[Rule], default: str, path: tuple[str, ...], entity: str, date_policy: str | None = None) -> tuple[str, Rule | None]:
    """The mode for a value: the narrowest rule wins, then a typed one, then the stricter; a full tie reports the first."""
    fits = [r for r in rules if _covers(r.scope, path) and r.entity in (None, entity)]
    strength = lambda r: (sum(1 if s == "[*]" else 2 for s in r.scope), r.entity is not None, MODES.index(r.mode))
    best = max(fits, key=strength, default=None)
    mode = best.mode if best else default
    if entity == "DATE" and mode == "mask" and date_policy and not any(r.entity == "DATE" for r in fits):
        mode = date_policy
    return mode, best


class Blocked(ValueError):
    """A value that may not pass at all was found."""


def mask_text(session: Session, text: str, spans: list[tuple[str, int, int]], rules: list[Rule] = (), default: str = "mask", path: tuple[str, ...] = (), date_policy: str = "allow") -> tuple[str, dict[str, int]]:
    """The text with its spans replaced from right to left, and how many new aliases of each type were given out.

    Dates have no alias: by the date policy they pass or are refused, and a rule that wants one masked refuses it.
    """
    counts: dict[str, int] = {}
    for entity, start, end in sorted(spans, key=lambda s: -s[1]):
        mode, _ = decide(list(rules), default, path, entity, date_policy)
        if mode == "block" or (entity == "DATE" and mode == "mask"):
            raise Blocked(entity)
        if mode == "allow":
            continue
        alias, again = session.mint(entity, text[start:end])
        counts[entity] = counts.get(entity, 0) + (not again)
        text = text[:start] + alias + text[end:]
    return text, counts


def restore_text(text: str, originals: dict[str, str]) -> tuple[str, int, int]:
    """The text with aliases given back, leftmost and longest first; how many came back, and how many of unknown origin stay."""
    if originals:
        shape = regex.compile("|".join(map(regex.escape, sorted(originals, key=len, reverse=True))))
        text, back = shape.subn(lambda m: originals[m[0]], text)
    else:
        back = 0
    return text, back, sum(m not in originals.values() for m in regex.findall(ALIAS_SHAPE, text))


def masked(rows: DataFrame, key: bytes, session: str = "doc_id", text: str = "text", rules: list[Rule] = (), default: str = "mask", date_policy: str = "allow", dictionary: D.Dictionary | None = None, code: str = "pattern") -> DataFrame:
    """(session, masked, aliases: map<alias, original>, counts) of rows of one text per session.

    Texts in which no shape can match pass in the JVM, where no dictionary is looked up; the others are scanned once. A text that holds a value which may not pass is refused: masked is null, and counts says which type under refused:<type>.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sid, body, spans in zip(batch["session"], batch["text"], batch["spans"], strict=True):
                own = Session(hmac.new(key, str(sid).encode(), hashlib.sha256).digest())
                if body is None or not len(spans):
                    out.append((sid, body, {}, {}))
                    continue
                own.withhold(body)
                try:
                    done, counts = mask_text(own, body, [(s["entity"], s["start"], s["end"]) for s in spans], rules, default, (), date_policy)
                except Blocked as refused:
                    out.append((sid, None, {}, {f"refused:{refused}": 1}))
                    continue
                out.append((sid, done, own.originals, counts))
            yield pd.DataFrame(out, columns=["session", "masked", "aliases", "counts"])

    body = rows.select(F.col(session).alias("session"), F.col(text).alias("text"))
    may = F.coalesce(F.col("text").rlike(D.MAY_MATCH), F.lit(False)) if dictionary is None else F.col("text").isNotNull()
    hit = D.detected(body.filter(may), "text", dictionary, code).mapInPandas(run, "session long, masked string, aliases map<string,string>, counts map<string,int>")
    empty = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,int>")
    return body.filter(~may).select(F.col("session").cast("long").alias("session"), F.col("text").alias("masked"), empty[0].alias("aliases"), empty[1].alias("counts")).unionByName(hit)


def masked_sessions(turns: DataFrame, key: bytes) -> DataFrame:
    """(session, turn, masked, aliases) of turns (session, turn, text): all turns of a session share its aliases, in the order of turns."""

    def run(own_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = Session(hmac.new(key, str(own_key[0]).encode(), hashlib.sha256).digest())
        group = group.sort_values("turn")
        for body in group["text"].dropna():
            own.withhold(body)
        out = []
        for turn, body in zip(group["turn"], group["text"], strict=True):
            spans = [] if body is None else chosen(D.scan(body))
            out.append((own_key[0], turn, None if body is None else mask_text(own, body, spans)[0], dict(own.originals)))
        return pd.DataFrame(out, columns=["session", "turn", "masked", "aliases"])

    return turns.groupBy("session").applyInPandas(run, "session long, turn long, masked string, aliases map<string,string>")


def chosen(spans: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """The winners among overlapping spans, as the column form chooses them."""
    kept: list[tuple[str, int, int]] = []
    for e, a, b, _ in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], D.ENTITIES.index(s[0]))):
        if b > a and all(b <= x or y <= a for _, x, y in kept):
            kept.append((e, a, b))
    return sorted(kept, key=lambda s: s[1])


def restored(rows: DataFrame) -> DataFrame:
    """rows (text, aliases) with restored, back and leaked."""

    @F.pandas_udf("restored string, back int, leaked int")
    def run(texts: pd.Series, aliases: pd.Series) -> pd.DataFrame:
        done = [restore_text(t, dict(a or {})) if t is not None else (None, 0, 0) for t, a in zip(texts, aliases, strict=True)]
        return pd.DataFrame(done, columns=["restored", "back", "leaked"])

    return rows.withColumn("r", run(F.col("text"), F.col("aliases"))).select(*rows.columns, "r.restored", "r.back", "r.leaked")


#: A session lives so long after its last use, and gives out so many aliases at most.
SESSION_TTL_MS, ALIAS_CEILING = 86_400_000, 10_000


def session_lives(uses: DataFrame, ttl_ms: int = SESSION_TTL_MS, ceiling: int = ALIAS_CEILING) -> DataFrame:
    """Lives of sessions from uses (session, at_ms, at_id, aliases: given out by a use): a use later than the time to live after the one before opens a new one."""
    order = Window.partitionBy("session").orderBy("at_ms", "at_id")
    fresh = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) > ttl_ms).cast("long"), F.lit(0))
    lived = uses.withColumn("fresh", fresh).withColumn("life", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return lived.groupBy("session", "life").agg(
        F.min("at_ms").alias("since"),
        F.max("at_ms").alias("last_use"),
        (F.max("at_ms") + ttl_ms).alias("expires"),
        F.sum("aliases").alias("aliases"),
        (F.sum("aliases") > ceiling).alias("over_ceiling"),
    )


def session_anchor(conversations: DataFrame) -> DataFrame:
    """(conv_id, anchor): a digest of a conversation's first system and first user text."""
    first = conversations.groupBy("conv_id").agg(*(F.min(F.when(F.col("role") == r, F.struct("turn", "text")))["text"].alias(r) for r in ("system", "user")))
    return first.select("conv_id", F.substring(F.sha2(F.concat_ws(chr(31), F.lit("anchor/v1"), F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256), 1, 16).alias("anchor"))


def is_alias_shaped(word: Column) -> Column:
    return word.rlike(r"^(LGL_|(PERSON|ORG|LOC|ADDRESS)_[0-9]+$)")


def governed_types(rules: list[Rule], default: str) -> list[str]:
    """Entity types whose values don't simply pass at the root of a request."""
    return [e for e in D.ENTITIES if decide(rules, default, (), e, "allow")[0] != "allow"]
