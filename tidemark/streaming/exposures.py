"""Exposure windows of sessions: opened once for an opportunity and task, closed by touches, time, capacity or the next prompt.

Rows: sid, ord, ts, kind (open, read, mutation, prompt, close), and opportunity, task, arm,
mode, surface, paths for an open, path for a touch, opportunity for a close. A touch counts
for every open window of its session. A window that times out is closed at its expiry,
whether a timer or a later row finds it. A repeated opportunity, or one of a task that had
one, is told as deduped as long as the session remembers it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row

from tidemark.streaming.ordered import logged, streamed

#: Touches, milliseconds and windows at which one closes; paths of a window; opportunities that a session remembers, and for how long after its last row.
TOUCHES, WINDOW_MS, WINDOWS, PATHS, SEEN, STATE_MS = 8, 30 * 60 * 1000, 16, 50, 128, 7 * 24 * 60 * 60 * 1000
ARMS, MODES = ("armed", "holdback"), ("randomized", "forced")

EVENTS = "sid long, at long, event string, opportunity string, task string, arm string, mode string, surface string, paths int, opened_at long, reason string, target_read boolean, target_mutation boolean, blind boolean, first_rank int, touches int, active boolean, enrolled string"


class Exposures:
    def __init__(self):
        self.windows: list[dict] = []
        self.seen: list[dict] = []
        self.last = 0

    def dump(self) -> list[str]:
        return [json.dumps(x) for x in [{"last": self.last}, *self.windows, *self.seen]] if self.windows or self.seen else []

    def load(self, texts: list[str]) -> None:
        for x in map(json.loads, texts):
            if "last" in x:
                self.last = x["last"]
            else:
                (self.windows if "expires_at" in x else self.seen).append(x)

    def due(self) -> int | None:
        return min([w["expires_at"] for w in self.windows] + ([self.last + STATE_MS + 1] if self.seen else []), default=None)

    def _event(self, at: int, event: str, of, **more) -> tuple:
        values = {"paths": len(of["paths"])} | more
        fields = ["paths", "opened_at", "reason", "target_read", "target_mutation", "blind", "first_rank", "touches", "active", "enrolled"]
        return at, event, *(of[c] for c in ("opportunity", "task", "arm", "mode", "surface")), *(values.get(f) for f in fields)

    def _closed(self, w: dict, reason: str, at: int) -> tuple:
        return self._event(at, "closed", w, **{k: w[k] for k in ("opened_at", "target_read", "target_mutation", "blind", "first_rank", "touches")}, reason=reason)

    def _close(self, reason: str, at: int, which=lambda w: True) -> list[tuple]:
        gone = [w for w in self.windows if which(w)]
        self.windows = [w for w in self.windows if not which(w)]
        return [self._closed(w, reason, at) for w in gone]

    def expire(self, now: int) -> list[tuple]:
        out = []
        while self.windows and now >= self.windows[0]["expires_at"]:  # they stand in the order in which they were opened
            w = self.windows.pop(0)
            out.append(self._closed(w, "timeout", w["expires_at"]))
        if now - self.last > STATE_MS:
            self.seen = []
        return out

    def take(self, row: Row) -> list[tuple]:
        out = self.expire(row.ts)
        self.last = max(self.last, row.ts)
        if row.kind == "open":
            out += self._open(row)
        elif row.kind in ("read", "mutation") and row.path:
            out += self._touch(row)
        elif row.kind == "prompt":
            out += self._close("next_prompt", row.ts)
        elif row.kind == "close" and row.opportunity:
            out += self._close("caller", row.ts, lambda w: w["opportunity"] == row.opportunity)
        return out

    def _open(self, row: Row) -> list[tuple]:
        paths = sorted({p for p in (row.paths if row.paths is not None else []) if p})[:PATHS]
        if not (row.opportunity and row.task and row.surface and paths) or row.arm not in ARMS:
            return []
        new = {k: getattr(row, k) for k in ("opportunity", "task", "arm", "surface")} | {"mode": row.mode if row.mode in MODES else "unknown", "paths": paths}
        for field, reason in (("opportunity", "exact_opportunity"), ("task", "task_already_enrolled")):
            if any(x[field] == new[field] for x in self.seen + self.windows):
                active = next((w for w in self.windows if w[field] == new[field]), None)
                return [self._event(row.ts, "deduped", new, reason=reason, active=active is not None, enrolled=active and active["opportunity"])]
        out = []
        if len(self.windows) >= WINDOWS:
            out.append(self._closed(self.windows.pop(0), "capacity", row.ts))
        state = {"opened_at": row.ts, "expires_at": row.ts + WINDOW_MS, "touches": 0, "target_read": False, "target_mutation": False, "blind": False, "first_rank": None, "read": []}
        self.windows.append(new | state)
        self.seen.append({"opportunity": new["opportunity"], "task": new["task"], "seen_at": row.ts})
        self._forget()
        return [*out, self._event(row.ts, "opened", new, opened_at=row.ts)]

    def _forget(self) -> None:
        """Open windows are always remembered; of the others the newest."""
        own = {w["opportunity"] for w in self.windows}
        others = sorted((x for x in self.seen if x["opportunity"] not in own), key=lambda x: (-x["seen_at"], x["opportunity"]))
        self.seen = [x for x in self.seen if x["opportunity"] in own] + others[: max(0, SEEN - len(own))]

    def _touch(self, row: Row) -> list[tuple]:
        full = False
        for w in self.windows:
            w["touches"] += 1
            full = full or w["touches"] >= TOUCHES
            if row.path not in w["paths"]:
                continue
            w["first_rank"] = w["first_rank"] or w["touches"]
            if row.kind == "read":
                w["target_read"] = True
                w["read"] = sorted({*w["read"], row.path})
            else:
                w["target_mutation"] = True
                w["blind"] = w["blind"] or row.path not in w["read"]
        return self._close("touch_limit", row.ts, lambda w: w["touches"] >= TOUCHES) if full else []


def exposure_log(rows: DataFrame) -> DataFrame:
    """What happens to the windows of a finished log; those still open time out."""
    return logged(rows, "sid", Exposures, EVENTS)


def exposure_stream(rows: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    return streamed(rows, "sid", Exposures, EVENTS, delay=delay)
