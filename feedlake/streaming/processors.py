"""Keyed processors with event-time timers: rows wait in state until the watermark has passed them, then come in order of time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000


class InOrder(StatefulProcessor):
    """Gives fold() the rows of a key in order of time. Rows that arrive out of order within the watermark's delay are put in order; a list in state holds
    those that wait, a timer stands at the first of them and at the time that fold() asks for.

    ``waiting`` is the schema of waiting rows, their time in ms first; ``kept`` that of what a key keeps; ``columns`` those of the output.
    """

    waiting, kept, columns = "at long", "value long", ("key", "at_ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.state = handle.getValueState("state", self.kept)

    def packed(self, batch: pd.DataFrame) -> list[tuple]:
        """A batch as waiting rows."""
        raise NotImplementedError

    def fold(self, key: object, state: tuple | None, rows: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        """Output rows, what the key keeps (None: nothing) and when to wake up without a new row, from rows in order, none later than ``now``."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in self.packed(batch)] if not pd.isna(key[0]) else []
        if new:
            self.rows.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        yield pd.DataFrame(columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted(map(tuple, self.rows.get()))
        ready, rest = [r for r in every if r[0] <= now], [r for r in every if r[0] > now]
        out, state, wake = self.fold(key[0], self.state.get() if self.state.exists() else None, ready, now)
        self.rows.put(rest) if rest else self.rows.clear()
        self.state.update(state) if state is not None else self.state.clear()
        for at in {t for t in (rest[0][0] if rest else None, wake) if t is not None}:
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


def _ms(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


class Cooldown(InOrder):
    """Lets a row through if the last one let through is ``gap_ms`` old or older; that time is forgotten when it can no longer hold a row back."""

    kept = "last long"

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def packed(self, batch: pd.DataFrame) -> list[tuple]:
        return [(t,) for t in _ms(batch["at"])]

    def fold(self, key, state, rows, now):
        last, out = state[0] if state else None, []
        for (at,) in rows:
            if last is None or at - last >= self.gap_ms:
                out.append((key, at))
                last = at
        if last is None or last + self.gap_ms <= now:
            return out, None, None
        return out, (last,), last + self.gap_ms


@dataclass(frozen=True)
class Rule:
    """How long a post is observed, what it has to reach, how often it is due for a check after that, and when it is given up."""

    minutes: int
    least: int
    retry_minutes: int = 30
    keep_minutes: int = 7 * 1440


class Observation(InOrder):
    """Waiting rows are (at, kind, likes, published, exempt), kind 0 for posts and 1 for checks; a key keeps its deadline and when it is due next."""

    waiting, kept, columns = "at long, kind int, likes long, published long, exempt boolean", "deadline long, due long", ("article", "verdict", "at_ms")

    def __init__(self, rule: Rule):
        self.rule = rule

    def packed(self, batch: pd.DataFrame) -> list[tuple]:
        likes, published = (batch[c].fillna(0).astype("int64").tolist() for c in ("likes", "published_ms"))
        return list(zip(_ms(batch["at"]), batch["kind"].astype(int).tolist(), likes, published, batch["exempt"].eq(True).tolist(), strict=True))

    def fold(self, key, state, rows, now):
        rule, out = self.rule, []

        def until(state: tuple | None, at: int) -> tuple | None:
            """What comes due before ``at``."""
            while state and state[1] < at:
                deadline, due = state
                end = deadline + rule.keep_minutes * MINUTE
                if due >= end:
                    out.append((key, "expired", end))
                    return None
                out.append((key, "due", due))
                state = deadline, min(due + rule.retry_minutes * MINUTE, end)
            return state

        for at, kind, likes, published, exempt in rows:
            state = until(state, at)
            deadline = state[0] if state else published + rule.minutes * MINUTE
            if kind and not state:
                continue  # a check of a post that is unknown or decided
            if exempt and not kind or likes >= rule.least:
                out.append((key, "pending", at))
                state = None
            elif at >= deadline or not state and not (rule.minutes and published):
                out.append((key, "filtered", at))
                state = None
            else:
                state = state or (deadline, deadline)
        state = until(state, now + 1)
        return out, state, state and state[1]
