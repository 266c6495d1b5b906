"""Lives of sessions as a stream's state: each use extends a life, and one that isn't used for its time to live is given out and forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ledgerline.operators.mask import ALIAS_CEILING, SESSION_TTL_MS
from ledgerline.streaming.ordered import InOrder, in_order


class SessionLives(InOrder):
    """Rows (at_ms, at_id, aliases). What stays of a session that expired is the number of its lives."""

    fields = StructType([StructField("at_ms", LongType()), StructField("at_id", LongType()), StructField("aliases", LongType())])
    kept = StructType([StructField(n, LongType()) for n in ("life", "since", "last_use", "aliases")])
    out = StructType([StructField("session", StringType())] + [StructField(n, LongType()) for n in ("life", "since", "last_use", "expires", "aliases")] + [StructField("over_ceiling", BooleanType())])

    def __init__(self, ttl_ms: int, ceiling: int) -> None:
        self.ttl, self.ceiling = ttl_ms, ceiling

    def load(self, held: tuple | None) -> None:
        self.life = held or (0, None, None, 0)

    def _ended(self) -> tuple:
        life, since, last, aliases = self.life
        self.life = (life + 1, None, None, 0)
        return (life, since, last, last + self.ttl, aliases, aliases > self.ceiling)

    def apply(self, row: tuple) -> list[tuple]:
        at, _, aliases = row
        over = self.life[2] is not None and at - self.life[2] > self.ttl
        out = [self._ended()] if over else []
        life, since, _, total = self.life
        self.life = (life, at if since is None else since, at, total + (aliases or 0))
        return out

    def expires(self) -> int | None:
        return None if self.life[2] is None else self.life[2] + self.ttl

    def expire(self, now: int) -> list[tuple]:
        at = self.expires()
        return [self._ended()] if at is not None and at <= now else []

    def save(self) -> tuple:
        return self.life


def session_lives_stream(uses: DataFrame, delay: str = "60 seconds", ttl_ms: int = SESSION_TTL_MS, ceiling: int = ALIAS_CEILING) -> DataFrame:
    """The lives that mask.session_lives tells of uses (session, at_ms, at_id, aliases), each when it has ended."""
    return in_order(uses, "session", SessionLives(ttl_ms, ceiling), delay)
