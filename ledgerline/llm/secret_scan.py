"""Secret scans by multipart credential linking.

Strong findings (assignments to secret-like names, access keys, long hexadecimal runs) are always
reported. Weak candidates are parts of a credential that mean little alone: names of an account, opaque
tokens, and endpoints. A scope is a part of a text between empty lines. An interval join links all parts
within a scope that don't overlap, however far apart they stand. A weak part is reported only where complementary parts
co-occur in its scope: an account or an opaque token needs the other or an endpoint and a secret, an endpoint needs an
account or access key and a secret. Only DataFrame functions are used; places come from the lengths of the
pieces between matches, in code points.

The interval join is a sweep: begins and ends of a scope's parts are sorted by place, and running extremes
tell every part whether one of each role ends before it or begins after it. So no pair of parts
is built, however many parts a scope holds. All patterns read a text in linear time, and sums over its
pieces are taken in blocks of about the square root of their number.

Defined results: null text is empty; a text without findings has counts 0, the digest of the empty string
and no spans; a weak part that overlaps a strong finding, or an earlier weak kind, is dropped; a null doc_id
is carried; repeated rows are scanned each; other columns are ignored; a long text without a break is
scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: The base kinds in their order, with pattern, group whose length counts, and least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: The weak kinds in their order: pattern, group whose length counts, least length.
WEAK = {
    "account": (r"""(?i)(client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    "opaque": (r"[A-Za-z0-9+/_-]+", 0, 20),
    # A scheme has 32 characters at most, so that a long run without :// is read once.
    "endpoint": (r"""[a-z][a-z0-9+.-]{0,31}://[^\x00-\x20"'<>]+""", 0, 8),
}
KINDS = [*BASE, *WEAK]

#: Between scopes: line feeds with at most spaces between them, and the white space after.
BREAK = r"\n[\x20\x09\x0D]*\n\s*"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _run(pattern: str, least: int) -> str:
    """A pattern of one greedy character class, for runs of at least so many: shorter runs needn't be matched to be dropped."""
    return pattern[:-1] + "{%d,}" % least


def _faster(kind: str) -> str:
    """The pattern that is run: for plain runs the least length is a part of it, which leaves out the same matches."""
    pattern, _, least = {**BASE, **WEAK}[kind]
    return {"access": r"AKIA[A-Z0-9]{14,}", "hex": _run(pattern, least), "opaque": r"(?<![A-Za-z0-9+/_-])" + _run(pattern, least)}.get(kind, pattern)


def _totals(lengths: Column) -> Column:
    """The sums of the lengths up to each, itself included, taken block by block: an array that grows is copied at each step."""
    none = F.array().cast("array<bigint>")
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731 - a value that is used in lambdas is worked out once

    def running(items: Column, start: Column) -> Column:
        step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + n)).alias("out"))
        return F.aggregate(items, F.struct(start.alias("sum"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, n: acc + n))
        before = F.concat(F.array(F.lit(0).cast("bigint")), running(sums, F.lit(0).cast("bigint")))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), running))

    def cut(own: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(own))).cast("int")
        return F.when(F.size(own) > 0, bound(F.transform(F.sequence(F.lit(1), F.size(own), block), lambda at: F.slice(own, at, block)), joined)).otherwise(none)

    return bound(lengths, cut)


def _ends(text: Column, pattern: str, whole: Column) -> Column:
    """Where each match ends, from the pieces of text between the matches."""
    pieces = F.split(text, pattern, -1)
    return _totals(F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint")))


def spans_of(text: Column, kind: str) -> Column:
    """Start, kind and end of the kind's matches that are long enough, in code points; leftmost, not overlapping."""
    pattern, (_, group, least) = F.lit(_faster(kind)), {**BASE, **WEAK}[kind]
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole
    ok = lambda m: (F.length(m["part"]) >= least) & ((m["whole"].rlike("[0-9]") & m["whole"].rlike("[A-Za-z]")) if kind == "opaque" else F.lit(True))
    matches = F.arrays_zip(whole.alias("whole"), part.alias("part"), _ends(text, _faster(kind), whole).alias("end"))
    span = lambda m: F.struct((m["end"] - F.length(m["whole"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))
    return F.when(text.rlike(_faster(kind)), F.transform(F.filter(matches, ok), span)).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    named = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), named), ",")


def _linked(parts: DataFrame) -> DataFrame:
    """(row, weak): the weak parts of parts (row, scope, start, kind, end) that are linked with complementary ones."""
    account, opaque, endpoint = (KINDS.index(k) for k in WEAK)
    roles = {"name": [KINDS.index("access"), account], "secret": [KINDS.index("assign"), KINDS.index("hex"), opaque], "endpoint": [endpoint]}
    # At one place ends come before begins: a part that ends where another begins stands before it.
    events = parts.select("*", F.explode(F.array(F.struct(F.col("end").alias("place"), F.lit(0).alias("begins")), F.struct(F.col("start").alias("place"), F.lit(1).alias("begins")))).alias("v"))
    events = events.select("row", "scope", "start", "kind", "end", "v.place", "v.begins")
    within = Window.partitionBy("row", "scope")
    upto = within.orderBy("place", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = within.orderBy(F.desc("place"), F.desc("begins")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("begins") == 1
    sweeps = {}
    for role, kinds in roles.items():
        own = F.col("kind").isin(kinds)
        sweeps[f"{role}_before"] = F.max(~begins & own).over(upto)
        sweeps[f"{role}_after"] = F.max(begins & own).over(after)
    for kind in range(len(KINDS) - 1):
        sweeps[f"over_{kind}"] = F.max(F.when(begins & (F.col("kind") == kind), F.col("end"))).over(upto)
    swept = events.withColumns(sweeps).filter(F.col("kind") >= len(BASE))
    # Seen from where it begins, a part's own end is not among what ended; seen from its end, its own begin is not among what begins.
    near = lambda role: F.max(F.when(begins, F.col(f"{role}_before")).otherwise(F.col(f"{role}_after"))).alias(role)
    earlier = F.greatest(F.lit(-1), *(F.when(F.col("kind") > k, F.col(f"over_{k}")) for k in range(len(KINDS) - 1)))
    found = swept.groupBy("row", "start", "kind", "end").agg(*map(near, roles), F.max(~begins & (earlier > F.col("start"))).alias("covered"))
    has = {role: F.coalesce(F.col(role), F.lit(False)) for role in roles}
    linked = F.when(F.col("kind") == account, has["secret"]).when(F.col("kind") == opaque, has["name"] | (has["endpoint"] & has["secret"])).otherwise(has["name"] & has["secret"])
    return found.filter(linked & ~F.col("covered")).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = texts.select("doc_id", "text", *(spans_of(text, k).alias(k) for k in KINDS))
    # Ends of empty lines cut a text into scopes; they matter only where a weak part was found.
    weak = F.size("account") + F.size("opaque") + F.size("endpoint")
    breaks = F.when((weak > 0) & text.rlike(BREAK), _ends(text, BREAK, F.regexp_extract_all(text, F.lit(BREAK), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    kept = C.settle(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KINDS, breaks.alias("breaks")), "secret-parts")

    strong = F.concat(*BASE)
    cuts = F.transform("breaks", lambda b: F.struct(b.alias("start"), F.lit(-1).alias("kind"), b.alias("end")))
    parts = kept.filter(weak > 0).select("row", F.explode(F.concat(cuts, *KINDS)).alias("s")).select("row", "s.*")
    # A part's scope is the number of breaks up to it.
    passed = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("scope", F.sum(F.when(F.col("kind") < 0, 1).otherwise(0)).over(passed)).filter("kind >= 0")
    out = kept.join(C.maybe_broadcast(C.settle(_linked(parts), "secret-weak")), "row", "left")
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(strong), 256).alias("base_sha256"),
        _joined(F.concat(strong, F.coalesce("weak", F.array().cast(_SPAN)))).alias("spans"),
    )
