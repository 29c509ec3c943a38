"""Lifetimes of agents' snapshots: a day each, and a cap for each repository that spares every agent's newest.

Rows: repo, ord, ts, agent, generation. A snapshot lives from ts for a day. After each new
one the repository keeps at most the cap: the newest of each agent first (newest agents, if
these alone are more), then the newest of the rest.
"""

from __future__ import annotations

import json
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.streaming.ordered import logged, streamed

#: Lifetime, snapshots that are kept, and agents that are listed.
TTL_MS, STORED, LISTED = 24 * 60 * 60 * 1000, 2048, 64
#: States of a snapshot that keep its agent off the list.
WITHHELD = ["identity_ambiguous", "spawn_withheld"]

ENDS = "repo long, agent string, ts long, generation long, ended_at long, reason string"


class Lifetimes:
    """The live snapshots as two heaps, the oldest first: each agent's newest, and the rest. A row costs the logarithm of what is kept, however many snapshots that is."""

    def __init__(self, stored: int = STORED):
        self.stored = stored
        self.newest: dict[str | None, tuple] = {}
        self.heads: list[tuple] = []  # every newest, and some that no longer are
        self.rest: list[tuple] = []

    def _add(self, ts: int, generation: int | None, agent: str | None) -> None:
        x = (ts, -1 if generation is None else generation, agent or "", generation, agent)
        own = self.newest.get(agent)
        if own is not None and x < own:
            heappush(self.rest, x)
            return
        if own is not None:
            heappush(self.rest, own)
        self.newest[agent] = x
        heappush(self.heads, x)

    def _oldest(self) -> tuple | None:
        """The oldest of the newest; those that a newer one has replaced are dropped on the way."""
        while self.heads and self.newest.get(self.heads[0][4]) != self.heads[0]:
            heappop(self.heads)
        return self.heads[0] if self.heads else None

    def dump(self) -> list[str]:
        return [json.dumps([ts, generation, agent]) for ts, _, _, generation, agent in [*self.newest.values(), *self.rest]]

    def load(self, texts: list[str]) -> None:
        for t in texts:
            self._add(*json.loads(t))

    def due(self) -> int | None:
        first = min([x[0] for x in (self._oldest(), self.rest[0] if self.rest else None) if x], default=None)
        return None if first is None else first + TTL_MS + 1

    def expire(self, now: int) -> list[tuple]:
        gone = []
        while self.rest and now - self.rest[0][0] > TTL_MS:
            gone.append(heappop(self.rest))
        while (x := self._oldest()) and now - x[0] > TTL_MS:
            gone.append(heappop(self.heads))
            del self.newest[x[4]]
        return [(agent, ts, generation, ts + TTL_MS, "expired") for ts, _, _, generation, agent in sorted(gone)]

    def take(self, row: Row) -> list[tuple]:
        out = self.expire(row.ts)
        self._add(row.ts, row.generation, row.agent)
        while len(self.newest) + len(self.rest) > self.stored:
            if self.rest:
                x = heappop(self.rest)
            else:
                x = self._oldest()
                heappop(self.heads)
                del self.newest[x[4]]
            out.append((x[4], x[0], x[3], row.ts, "cap"))
        return out


def lifetime_log(rows: DataFrame, *, stored: int = STORED) -> DataFrame:
    """When and why each snapshot of a finished log ends."""
    return logged(rows, "repo", lambda: Lifetimes(stored), ENDS)


def lifetime_stream(rows: DataFrame, *, stored: int = STORED, delay: str = "10 minutes") -> DataFrame:
    return streamed(rows, "repo", lambda: Lifetimes(stored), ENDS, delay=delay)


def listed(snapshots: DataFrame, now: int, *, most: int = LISTED) -> DataFrame:
    """Of snapshots (repo, agent, ts, generation, state), each agent's newest live one, the newest agents of a repository; agents whose newest is ambiguous or withheld aren't listed."""
    live = snapshots.filter((F.col("ts") > now) | (now - F.col("ts") <= TTL_MS))
    own = Window.partitionBy("repo", "agent").orderBy(F.desc("ts"), F.desc("generation"), F.desc("state"))
    newest = live.withColumn("own", F.row_number().over(own)).filter("own = 1").filter(~F.coalesce(F.col("state"), F.lit("")).isin(WITHHELD))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ts"), "agent"))
    return newest.withColumn("place", place).filter(F.col("place") <= most).select("repo", "agent", "ts", "generation", "place")
