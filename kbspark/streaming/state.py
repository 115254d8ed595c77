"""Keyed state of the streams: what each key remembers, when it speaks and when it is forgotten."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    """``processor`` over a stream with a watermark. All timers are in event time: in processing time a stream that is to
    end when its input does would wait for them for ever."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(key).transformWithState(processor, schema, mode, "eventTime")


class Leaving(StatefulProcessor):
    """Items that leave at a time of their own: the newest row of an item tells when, and one that no longer
    leaves stays. An item whose time has come is emitted and forgotten.

    A key holds a group of items, as every call to the state costs far more than a row in it. A micro-batch appends
    one entry with its newest row of each item. One timer per key stands at its earliest leaving; there
    what is due is emitted, and the rest put back as one entry.

    Rows: ``memory_id, ts_ms, leave_ms``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "memory_id array<string>, ts_ms array<bigint>, leave_ms array<bigint>")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    @staticmethod
    def _wakes(ts: int, leave: int) -> int:
        """Once event time is past its leaving; one that stays is remembered while older rows of it may come."""
        return (leave if leave >= 0 else ts) + 1

    def _keep(self, items: dict[str, tuple[int, int]]) -> None:
        self.waiting.appendValue((list(items), [ts for ts, _ in items.values()], [leave for _, leave in items.values()]))
        at = min(self._wakes(*item) for item in items.values())
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh: dict[str, tuple[int, int]] = {}
        for r in rows:
            memory, item = r["memory_id"], (r["ts_ms"], -1 if r["leave_ms"] is None else r["leave_ms"])
            fresh[memory] = max(fresh.get(memory, item), item)
        self._keep(fresh)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held: dict[str, tuple[int, int]] = {}
        for entry in self.waiting.get():
            for memory, *item in zip(*entry):
                if memory not in held or item[0] >= held[memory][0]:
                    held[memory] = tuple(item)
        rest = {m: item for m, item in held.items() if self._wakes(*item) > passed}
        self.waiting.clear()
        self.timer.clear()
        if rest:
            self._keep(rest)
        for memory, item in held.items():
            if memory not in rest and item[1] >= 0:
                yield Row(memory_id=memory, leave_ms=item[1])

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows of a key are kept until the watermark has passed them and then taken in the order of ``ts_us`` and
    ``number``, however they came. One timer per key stands at its earliest row. When no row waits, it stands
    where the key may be forgotten.

    Rows: ``ts_us`` and a number that tells equal times apart; the stream's event time is that in whole
    milliseconds, as watermarks are.
    """

    number = "number"
    memory = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us bigint, number bigint")
        self.kept = handle.getValueState("kept", self.memory)
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def take(self, key: Any, kept: tuple | None, rows: list[tuple[int, int]]) -> tuple[tuple, list[Row]]:
        """What is remembered after ``rows``, and what is emitted."""
        raise NotImplementedError

    def forget_at(self, kept: tuple) -> int | None:
        """The time in ms from which nothing remembered makes a difference."""
        raise NotImplementedError

    def _wait_until(self, at: int | None) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if at is not None and old == at:
                return
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [(r["ts_us"], r[self.number]) for r in rows]
        first = min(fresh)[0]
        if self.waiting.exists():
            first = min(first, min(r[0] for r in self.waiting.get()))
        self.waiting.appendList(fresh)
        self._wait_until(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] // 1000 <= passed]
        if not due:
            # No row was waiting: the key has been silent long enough.
            self.kept.clear()
            self.waiting.clear()
            return
        rest = rows[len(due) :]
        kept, out = self.take(key, tuple(self.kept.get()) if self.kept.exists() else None, due)
        self.kept.update(kept)
        if rest:
            self.waiting.put(rest)
            self._wait_until(rest[0][0] // 1000)
        else:
            self.waiting.clear()
            end = self.forget_at(kept)
            if end is not None and end <= passed:
                self.kept.clear()
            else:
                self._wait_until(end)
        yield from out

    def close(self) -> None:
        pass


class Debounce(InOrder):
    """An event is accepted if its key has accepted none within the gap before it."""

    number, memory = "event_id", "last_us bigint"

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def take(self, key: Any, kept: tuple | None, rows: list[tuple[int, int]]) -> tuple[tuple, list[Row]]:
        out, last = [], kept[0] if kept else None
        for ts, event in rows:
            if last is None or ts - last >= self.gap:
                last = ts
                out.append(Row(path=key[0], event_id=event, ts_us=ts))
        return (last,), out

    def forget_at(self, kept: tuple) -> int:
        # Later events are past the watermark, hence past the gap, and accepted anyway.
        return -(-(kept[0] + self.gap) // 1000)


class EveryNth(InOrder):
    """Every ``every``-th turn of a session; one that comes ``idle_us`` after the turn before starts from one again."""

    number, memory = "turn_no", "seen bigint, last_us bigint"

    def __init__(self, every: int, idle_us: int | None):
        self.every, self.idle = every, idle_us

    def take(self, key: Any, kept: tuple | None, rows: list[tuple[int, int]]) -> tuple[tuple, list[Row]]:
        out, (seen, last) = [], kept or (0, None)
        for ts, turn in rows:
            if self.idle is not None and last is not None and ts - last >= self.idle:
                seen = 0
            seen, last = seen + 1, ts
            if seen % self.every == 0:
                out.append(Row(session_id=key[0], turn_count=seen, turn_no=turn))
        return (seen, last), out

    def forget_at(self, kept: tuple) -> int | None:
        return None if self.idle is None else -(-(kept[1] + self.idle) // 1000)


class NewestTurns(StatefulProcessor):
    """The newest ``limit`` turns of a session: a user's row and the assistant's row after it. Each micro-batch
    emits those of the sessions that it changes.

    A row waits for its other half, unless ``limit`` newer turns are complete already, so a session keeps a
    bounded number of turns. ``idle_us`` after its last row it is forgotten.

    Rows: ``session_id, turn, role, text, ts_us``.
    """

    def __init__(self, limit: int, idle_us: int | None):
        self.limit, self.idle = limit, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint, question string, answer string")
        self.halves = handle.getListState("halves", "turn bigint, asked boolean, text string")
        self.last = handle.getValueState("last", "ts_us bigint")

    def _wakes(self, last_us: int) -> int:
        return -(-(last_us + self.idle) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        turns = {r[0]: (r[1], r[2]) for r in self.turns.get()} if self.turns.exists() else {}
        halves = {(r[0], r[1]): r[2] for r in self.halves.get()} if self.halves.exists() else {}
        before, last = dict(turns), self.last.get()[0] if self.last.exists() else None
        newest_us, rows = last, list(rows)
        if self.idle is not None and last is not None and min(r["ts_us"] for r in rows) - last >= self.idle:
            turns, halves = {}, {}  # its time was up, though the watermark is not there yet
        for r in rows:
            newest_us = r["ts_us"] if newest_us is None else max(newest_us, r["ts_us"])
            if r["role"] in ("user", "assistant"):
                asked = r["role"] == "user"
                # An answer is filed under the turn it answers.
                halves[(r["turn"] if asked else r["turn"] - 1, asked)] = r["text"]
        for turn, asked in list(halves):
            if asked and (turn, False) in halves:
                turns[turn] = (halves.pop((turn, True)), halves.pop((turn, False)))
        newest = sorted(turns, reverse=True)[: self.limit]
        turns = {t: turns[t] for t in newest}
        if len(newest) == self.limit:
            halves = {k: v for k, v in halves.items() if k[0] > newest[-1]}
        if turns:
            self.turns.put([(t, *turns[t]) for t in newest])
        if halves:
            self.halves.put([(*k, v) for k, v in halves.items()])
        elif self.halves.exists():
            self.halves.clear()
        if self.idle is not None and newest_us != last:
            if last is not None:
                self.handle.deleteTimer(self._wakes(last))
            self.handle.registerTimer(self._wakes(newest_us))
            self.last.update((newest_us,))
        if turns != before:
            for t in newest:
                yield Row(session_id=key[0], turn=t, question=turns[t][0], answer=turns[t][1])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.turns, self.halves, self.last):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass
