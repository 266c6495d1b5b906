"""Names that lead to addresses through chains of aliases, message by message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.tables import settle

#: Aliases that a chain follows at most.
HOPS = 8


def reached(records: DataFrame, questions: DataFrame, hops: int = HOPS) -> DataFrame:
    """(message, name, at, life): what questions (message, name) reach over aliases of records (message, owner, alias_to, ttl) in 1 to hops steps.

    life is the largest, over the ways that lead there, of the least lifetime on the way. Each round goes one alias
    further from the names that the last one reached, of which each counts once; so a loop is walked no further than hops, and rounds
    end when nothing is reached.
    """
    aliases = settle(records.filter("alias_to is not null").groupBy("message", F.col("owner").alias("at"), "alias_to").agg(F.max("ttl").alias("ttl")), "aliases")
    front = questions.select("message", "name", F.col("name").alias("at"), F.lit(None).cast("long").alias("life")).filter("name is not null").distinct()
    rounds: list[DataFrame] = []
    for _ in range(hops):
        step = front.join(aliases, ["message", "at"]).groupBy("message", "name", F.col("alias_to").alias("to")).agg(F.max(F.least("life", "ttl")).alias("life"))
        front = settle(step.withColumnRenamed("to", "at"), "alias-round")
        if front.isEmpty():
            break
        rounds.append(front)
    every = front.limit(0)
    for one in rounds:
        every = every.unionByName(one)
    return every.groupBy("message", "name", "at").agg(F.max("life").alias("life"))


def address_names(records: DataFrame, questions: DataFrame, hops: int = HOPS) -> DataFrame:
    """(message, ip, name, ttl, least_ttl): the names of each address of records (message, owner, alias_to, ip, ttl).

    They are the owner of its record, and each name asked for whose aliases lead to the owner. ttl is the address
    record's, least_ttl the least on the way; of equal pairs the longest stays.
    """
    addresses = records.filter("ip is not null").groupBy("message", F.col("owner").alias("at"), "ip").agg(F.max("ttl").alias("ttl"))
    own = addresses.select("message", "ip", F.col("at").alias("name"), "ttl", F.col("ttl").alias("least_ttl"))
    led = addresses.join(reached(records, questions, hops).filter("name <> at"), ["message", "at"])
    led = led.select("message", "ip", "name", "ttl", F.least("ttl", "life").alias("least_ttl"))
    return own.unionByName(led).groupBy("message", "ip", "name").agg(F.max("ttl").alias("ttl"), F.max("least_ttl").alias("least_ttl"))
