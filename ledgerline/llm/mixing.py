"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, have the weights 5, 2, 1, repeating. They share a budget in
words; a source's target stops at twice its own size, and what it can't take is shared again by weight
among the others. Each document is expected target / source size times. Within a source the documents
stand in an order of size, their expected copies are summed up along it, one fixed offset is added, and
a document is taken once for every integer boundary that its step crosses; so no document is taken more
than ceil(expected) times and the taken words lie near the target.

The sums are distributed: rows are dealt to ranges of the order, summed within each range, and the sums
of whole ranges are added. The targets come from the same sums over the table of sources, so neither a
source with any share of the rows nor any number of sources is gathered in one task or the driver.

Defined results: null text has size 0, and so a source of empty texts has target 0 and rate 0; a null
source is a source of its own, the last; repeated rows are documents of their own; a null doc_id is
ordered first; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
LIMIT = 2
#: Rows for each bucket of the order within a band of sizes.
CELL = 20_000


def n_words(text: Column) -> Column:
    """How many runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: list[int]) -> list[Fraction]:
    """Exact targets of the sources, in their order, in plain Python: what mixture() works out on tables."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = Fraction(SHARE[0] * sum(sizes), SHARE[1]) - sum(LIMIT * sizes[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        goal = [Fraction(LIMIT * s) if i in full else rest * weights[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and goal[i] > LIMIT * s}
        if not over:
            return goal
        full |= over


def _part_of_hash(text: Column) -> Column:
    """The first 32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_rates(sized: DataFrame) -> DataFrame:
    """of (source), source_size, target, rate and offset for every source of sized (source, size).

    Sources fill up in order of size by weight; from the first one on that isn't full, the rest of the budget is shared by weight.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    named = C.running(sources, None, [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before_one") % len(WEIGHTS) + 1).cast("int"))
    named = C.settle(named.select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")
    total = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total.size is None:
        return C.settle(named.select(F.col("source").alias("of"), "source_size", *(F.lit(0.0).alias(c) for c in ("target", "rate", "offset"))), "mix-rates")
    lap = F.col("source_size") * (F.lit(math.lcm(*WEIGHTS)) / F.col("weight")).cast("long")
    filled = C.running(named, None, [lap, F.col("source").asc_nulls_last()], ["source_size", "weight"])
    # Twice the budget that is left (in units of 1 / SHARE[1]), and the weight that is open, when the sources before are full.
    left = F.lit(SHARE[0] * total.size).cast("decimal(38,0)") - SHARE[1] * LIMIT * wide("before_source_size")
    filled = C.settle(filled.select("*", left.alias("left"), (F.lit(total.weight) - F.col("before_weight")).alias("open"), lap.alias("lap")), "mix-filled")
    fits = wide("weight") * F.col("left") <= SHARE[1] * LIMIT * wide("source_size") * wide("open")
    cut = filled.filter(fits).agg(F.min(F.struct("lap", F.col("source").isNull().alias("last"), "source", "left", "open")).alias("cut")).first().cut
    after = (F.col("lap") > cut.lap) | ((F.col("lap") == cut.lap) & (F.col("source").isNull() | F.coalesce(F.col("source") >= F.lit(cut.source), F.lit(False))))
    shared = (F.col("weight") * F.lit(cut.left)).cast("double") / F.lit(float(SHARE[1] * cut.open))
    target = F.when(after, shared).otherwise((LIMIT * F.col("source_size")).cast("double"))
    offset = _part_of_hash(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("None")))) / F.lit(2.0**32)
    goals = filled.select(F.col("source").alias("of"), "source_size", target.alias("target"), offset.alias("offset"))
    return C.settle(goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-rates")


def mixture(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target and copies; the text isn't carried."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = C.settle(sized.withColumns({"row": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")}), "mix-sizes")
    rates = source_rates(sized)
    buckets = max(1, sized.count() // CELL)
    band = F.floor(F.sqrt(F.col("size").cast("double"))).cast("int")
    bucket = F.pmod(_part_of_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(buckets)).cast("int")
    order = [F.col(c).asc_nulls_first() for c in ("band", "bucket", "size", "doc_id", "row")]
    ranked = C.running(sized.withColumns({"band": band, "bucket": bucket}), "source", order, ["one"]).withColumn("k", F.col("before_one") + 1)
    out = ranked.join(C.maybe_broadcast(rates), F.col("source").eqNullSafe(F.col("of")))
    crossed = F.floor(F.col("k") * F.col("rate") + F.col("offset")) - F.floor((F.col("k") - 1) * F.col("rate") + F.col("offset"))
    return out.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs, each row as many times as the mixture takes it; rows that share a doc_id are told apart by source and size."""
    plan = C.settle(mixture(docs), "mix-plan")
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = docs.select(C.packed(docs), own.alias("own"))
    again = plan.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).filter("copies > 0")
    again = C.settle(again.select(F.struct("doc_id", "source", "size").alias("key"), "n", "copies"), "mix-copies")
    # Rows that agree in doc_id, source and size share their copies: each takes the whole part, the first ones the rest.
    match = F.col("own").eqNullSafe(F.col("key"))
    once, several = again.filter("n = 1"), again.filter("n > 1")
    out = rows.join(C.maybe_broadcast_of(once, again), match).select("doc", "copies")
    if not several.isEmpty():
        alike = Window.partitionBy("own").orderBy(F.xxhash64("doc"))
        shared = rows.join(C.maybe_broadcast_of(several, again), match).withColumn("at", F.row_number().over(alike) - 1)
        share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("at") < F.col("copies") % F.col("n"), 1).otherwise(0)
        out = out.unionByName(shared.select("doc", share.cast("long").alias("copies")).filter("copies > 0"))
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
