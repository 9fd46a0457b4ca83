"""Keyed state machines on ``transformWithState``, in event-time order.

Rows of a key wait in state until the watermark has passed them; a timer then wakes the key, its rows
are applied in order, and whatever has run out by the watermark ends in its own right, without a later
row. The result therefore does not depend on the order of arrival within the watermark. What waits is
bounded by the rows of a key inside the watermark's delay; rows behind the watermark are dropped by
Spark, as in any event-time operator. State lives in the RocksDB store, one structured state for each
kind of thing."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from keelson.streaming import views

c = F.col

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, key: str, time: str, delay: str, processor: StatefulProcessor, output: str) -> DataFrame:
    """``stream`` grouped by ``key`` and fed to ``processor``; adds the column at (microseconds of ``time``)."""
    conf = stream.sparkSession.conf
    if conf.get(PROVIDER, None) != ROCKS:
        conf.set(PROVIDER, ROCKS)  # states of several kinds need this store; a query keeps what it began with
    rows = stream.withColumn("at", F.unix_micros(c(time).cast("timestamp"))).withWatermark(time, delay)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime")


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def ceil_ms(micros: int) -> int:
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Applies the rows of a key in (at, tie) order once the watermark has passed them.

    ``rows``: schema of what waits. Subclasses open their states in ``opened``, read them in ``load``
    before a run of rows, take a row in ``apply``, end what has run out in ``expire``, write what has
    changed in ``save`` and name the next end in ``due``."""

    def __init__(self, rows: str, tie: str, output: str):
        self.rows, self.tie, self.output = rows, tie, output
        self.kinds = [{"bigint": int, "double": float, "string": str, "boolean": bool}[x.split()[1]] for x in rows.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", self.rows)
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None: ...

    def load(self) -> None: ...

    def save(self) -> None: ...

    def apply(self, key, row: dict) -> list[tuple]:
        raise NotImplementedError

    def expire(self, key, now: int) -> list[tuple]:
        return []

    def due(self) -> int | None:
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fields, first = names_of(self.rows), None
        for frame in rows:
            # all rows of a batch in one call; pandas turns a column of longs with nulls into doubles
            columns = [[None if v is None or v != v else kind(v) for v in frame[x]] for x, kind in zip(fields, self.kinds, strict=True)]
            self.early.appendList(list(zip(*columns, strict=True)))
            first = min(frame["at"].min(), first) if first is not None else frame["at"].min()
        if first is not None:
            self.handle.registerTimer(ceil_ms(int(first)))
        yield pd.DataFrame(columns=names_of(self.output))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        fields, at = names_of(self.rows), names_of(self.rows).index("at")
        waiting = [tuple(x) for x in self.early.get()]
        ready = [x for x in waiting if x[at] <= now]
        rest = [x for x in waiting if x[at] > now]
        out: list[tuple] = []
        self.load()
        if ready:
            tie = fields.index(self.tie)
            for x in sorted(ready, key=lambda x: (x[at], x[tie])):
                out += self.apply(key[0], dict(zip(fields, x, strict=True)))
            if rest:
                self.early.put(rest)
            else:
                self.early.clear()
        out += self.expire(key[0], now)
        self.save()
        wake = [x[at] for x in rest]
        if (end := self.due()) is not None:
            wake.append(end)
        if wake:
            self.handle.registerTimer(ceil_ms(min(wake)))
        yield pd.DataFrame(out, columns=names_of(self.output))

    def close(self) -> None: ...


class Leases(InOrder):
    """Holder intervals of claims and heartbeats; a lease without a later event ends when its timer fires."""

    OUTPUT = "entry bigint, event_id bigint, actor bigint, held_from bigint, held_until bigint, lapsed boolean, contended boolean"

    def __init__(self, ttl_seconds: int):
        super().__init__("at bigint, event_id bigint, actor bigint, action string", "event_id", self.OUTPUT)
        self.ttl = ttl_seconds * 1_000_000

    def opened(self, handle):
        self.kept = handle.getValueState("last", "at bigint, event_id bigint, actor bigint, action string, contended boolean, ended boolean")

    def load(self):
        self.last = self.kept.get()

    def save(self):
        self.kept.update(tuple(self.last))

    def _interval(self, key, until, lapsed):
        at, event_id, actor, _, contended, _ = self.last
        return key, event_id, actor, at, until, lapsed, contended

    def _open(self) -> bool:
        return self.last is not None and self.last[3] != "release" and not self.last[5]

    def apply(self, key, row):
        last, out = self.last, []
        held = last is not None and last[3] != "release"
        if self._open():
            end = last[0] + self.ttl
            out.append(self._interval(key, min(end, row["at"]), row["at"] > end))
        contended = bool(held and row["action"] == "claim" and last[0] + self.ttl > row["at"] and last[2] != row["actor"])
        self.last = (row["at"], row["event_id"], row["actor"], row["action"], contended, False)
        return out

    def expire(self, key, now):
        if not self._open() or self.last[0] + self.ttl > now:
            return []
        out = [self._interval(key, self.last[0] + self.ttl, True)]
        self.last = (*self.last[:5], True)
        return out

    def due(self):
        return self.last[0] + self.ttl if self._open() else None


def lease_stream(log: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """Stream form of ``views.lease_intervals``: an interval is emitted when its successor is due or its lease
    has run out, whichever the watermark passes first. ``log``: entry, ts, event_id, actor, action."""
    out = with_state(log, "entry", "ts", delay, Leases(ttl_seconds), Leases.OUTPUT)
    return out.withColumns({x: F.timestamp_micros(x) for x in ("held_from", "held_until")})


class Slots(InOrder):
    """One outstanding entry a channel and a queue behind it; completion promotes the head of the queue."""

    OUTPUT = "channel bigint, entry bigint, start bigint, wait bigint, next bigint"

    def __init__(self):
        super().__init__("at bigint, entry bigint, service bigint", "entry", self.OUTPUT)

    def opened(self, handle):
        self.kept = handle.getListState("queue", "at bigint, entry bigint, service bigint")
        self.until = handle.getValueState("until", "until bigint")

    def load(self):
        self.before = [tuple(x) for x in self.kept.get()]
        self.queue = deque(self.before)
        self.end = (self.until.get() or (None,))[0]

    def save(self):
        if self.queue and list(self.queue) != self.before:
            self.kept.put(list(self.queue))
        elif self.before and not self.queue:
            self.kept.clear()
        if self.end is None:
            self.until.clear()
        else:
            self.until.update((self.end,))

    def expire(self, key, now):
        """Completions up to ``now``; every one starts the head of the queue where it ends."""
        out = []
        while self.end is not None and self.end <= now:
            if not self.queue:
                self.end = None
                break
            at, entry, service = self.queue.popleft()
            out.append((key, entry, self.end, self.end - at, self.queue[0][1] if self.queue else None))
            self.end += service
        return out

    def apply(self, key, row):
        out = self.expire(key, row["at"])
        if self.end is None:
            self.end = row["at"] + row["service"]
            out.append((key, row["entry"], row["at"], 0, None))
        else:
            self.queue.append((row["at"], row["entry"], row["service"]))
        return out

    def due(self):
        return self.end


def slot_stream(entries: DataFrame, delay: str) -> DataFrame:
    """Stream form of ``views.serial_slots``: a row when an entry becomes the outstanding one of its channel,
    with its wait and the entry that is next by then. Times in microseconds. ``entries``: channel, entry,
    created (timestamp), service (microseconds)."""
    return with_state(entries, "channel", "created", delay, Slots(), Slots.OUTPUT)


class Coordination(StatefulProcessor):
    """Folds the changes of an event in revision order, whatever order they arrive in.

    A change whose predecessor is missing waits in a list; it is applied as soon as the predecessor comes,
    or once the watermark has passed it, and then the gap is reported. The list is read and written as a
    whole, and only what still waits after a batch is written: a call for each change would cost far more."""

    OUTPUT = "event bigint, revision bigint, gap boolean, outcome string, status string, phase string, phase_revision bigint, approvals bigint"
    CHANGE = "at bigint, expected bigint, action string, actor bigint, proposal bigint, target string, approvers array<bigint>, expected_phase bigint"

    def init(self, handle):
        self.handle = handle
        self.early = handle.getListState("early", f"revision bigint, {self.CHANGE}")
        self.fold = handle.getValueState(
            "fold", "revision bigint, ended boolean, phase string, phase_revision bigint, proposal bigint, target string, proposer bigint, required array<bigint>, agreed array<bigint>",
        )

    EMPTY = (0, False, None, 0, None, None, None, [], [])

    @staticmethod
    def step(state: tuple, revision: int, change: tuple) -> tuple[tuple, str]:
        """(state, outcome) after one change: ``applied``, ``stale`` or ``rejected``."""
        before, ended, phase, phase_revision, proposal, target, proposer, required, agreed = state
        _, expected, action, actor, of, to, approvers, expected_phase = change
        left = (revision, *state[1:])
        if expected != before:
            return left, "stale"
        if action in ("close", "reopen"):
            return (left, "rejected") if ended == (action == "close") else ((revision, not ended, *state[2:]), "applied")
        if action not in ("propose", "agree", "withdraw", "commit"):
            return left, "applied"
        if ended or expected_phase != phase_revision:
            return left, "rejected"
        if action == "propose":
            if proposal is not None or phase == to:
                return left, "rejected"
            return (revision, ended, phase, phase_revision, of, to, actor, sorted({actor, *(approvers or [])}), [actor]), "applied"
        if proposal is None or proposal != of:
            return left, "rejected"
        if action == "agree":
            if actor not in required:
                return left, "rejected"
            return (revision, ended, phase, phase_revision, proposal, target, proposer, required, sorted({*agreed, actor})), "applied"
        if action == "withdraw":
            return (left, "rejected") if actor != proposer else ((revision, ended, phase, phase_revision, None, None, None, [], []), "applied")
        if set(required) - set(agreed):
            return left, "rejected"
        return (revision, ended, target, phase_revision + 1, None, None, None, [], []), "applied"

    def _state(self) -> tuple:
        kept = self.fold.get()
        return self.EMPTY if kept is None else (*kept[:7], [int(x) for x in kept[7]], [int(x) for x in kept[8]])

    def _fold(self, key, early: dict[int, tuple], through: int) -> list[tuple]:
        """Applies what follows without a gap, and all revisions up to ``through``."""
        state, out, done = self._state(), [], []
        for revision in sorted(early):
            if revision > state[0] + 1 and revision > through:
                break
            done.append(revision)
            if revision <= state[0]:
                out.append((key, revision, False, "late", *self._seen(state)))
                continue
            gap = revision > state[0] + 1
            state, outcome = self.step(state, revision, early[revision])
            out.append((key, revision, gap, outcome, *self._seen(state)))
        if done:
            self.fold.update(state)
            for revision in done:
                del early[revision]
        return out

    @staticmethod
    def _seen(state: tuple) -> tuple:
        return "ended" if state[1] else "active", state[2], state[3], len(state[8])

    def _early(self) -> dict[int, tuple]:
        return {int(x[0]): tuple(x[1:]) for x in self.early.get()}

    def _emit(self, out: list[tuple], early: dict[int, tuple], before: list[int]) -> Iterator[pd.DataFrame]:
        """Writes what waits beyond ``before``, the revisions that the list holds, or the whole list if some of those have gone."""
        rows = [(revision, *change) for revision, change in early.items()]
        if any(x not in early for x in before):
            self.early.put(rows) if rows else self.early.clear()
        elif rows[len(before) :]:
            self.early.appendList(rows[len(before) :])
        if early:
            self.handle.registerTimer(ceil_ms(min(x[0] for x in early.values())))
        yield pd.DataFrame(out, columns=names_of(self.OUTPUT))

    def handleInputRows(self, key, rows, timerValues):
        early = self._early()
        before, fields = list(early), names_of(self.CHANGE)
        for frame in rows:
            kept = frame[["revision", *fields]].astype(object)
            for x in kept.itertuples(index=False):
                change = tuple(None if y is None or y != y else y for y in (list(map(int, v)) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in x[1:]))
                early.setdefault(int(x[0]), change)  # the first of several with one revision counts
        yield from self._emit(self._fold(key[0], early, -1), early, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        early = self._early()
        before = list(early)
        passed = [r for r, x in early.items() if x[0] <= now]
        out = self._fold(key[0], early, max(passed)) if passed else []
        yield from self._emit(out, early, before)

    def close(self):
        pass


def coordination_stream(changes: DataFrame, delay: str) -> DataFrame:
    """Every change of a coordination log with what it led to.

    ``changes``: event, revision, time, expected, action (close, reopen, propose, agree, withdraw,
    commit or a note), actor, proposal, target, approvers, expected_phase. A phase moves when all that a
    proposal asks have agreed; a change that expects another revision than the one before is stale."""
    return with_state(changes, "event", "time", delay, Coordination(), Coordination.OUTPUT)


class WorkingSet(InOrder):
    """Items of a session in task frames, under one budget of items and characters.

    A row activates its frame; beyond ``frames`` the least recently activated other frame goes with all
    it holds. ``observe`` adds an item or renews it (best activation); beyond ``items`` or ``characters``
    the weakest, then longest unrenewed ordinary item of any frame goes. ``maintain`` sets the pinned
    state of the frame: it is never evicted, and refused if it does not fit beside what is there.
    ``clear`` removes it. An item past its time to live counts towards the budget but is not live."""

    OUTPUT = "session bigint, event_id bigint, outcome string, evicted array<string>, items int, characters bigint, frames int, live int"
    PINNED = ""  # the item of a frame's maintained state

    def __init__(self, items: int, characters: int, frames: int):
        super().__init__("at bigint, event_id bigint, action string, frame bigint, item string, size bigint, activation double, ttl bigint", "event_id", self.OUTPUT)
        self.most_items, self.most_characters, self.most_frames = items, characters, frames

    def opened(self, handle):
        self.item_state = handle.getMapState("items", "frame bigint, item string", "activation double, created bigint, renewed bigint, size bigint, ttl bigint, content string")
        self.frame_state = handle.getMapState("frames", "frame bigint", "activated bigint, event_id bigint")

    def load(self):
        self.items = {tuple(k): tuple(v) for k, v in self.item_state.iterator()}
        self.frames = {k[0]: tuple(v) for k, v in self.frame_state.iterator()}
        self.old_items, self.old_frames = dict(self.items), dict(self.frames)

    def save(self):
        for state, old, new, key in ((self.item_state, self.old_items, self.items, lambda k: k), (self.frame_state, self.old_frames, self.frames, lambda k: (k,))):
            for k in old.keys() - new.keys():
                state.removeKey(key(k))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue(key(k), v)

    def _size(self, skip=None) -> tuple[int, int]:
        left = [v[3] for k, v in self.items.items() if k != skip]
        return len(left), sum(left)

    def apply(self, key, row):
        at, frame = row["at"], row["frame"]
        gone: list[str] = []
        self.frames[frame] = (at, row["event_id"])
        while len(self.frames) > self.most_frames:
            oldest = min((f for f in self.frames if f != frame), key=lambda f: self.frames[f], default=None)
            if oldest is None:
                break
            del self.frames[oldest]
            gone += [f"{f}/{i}" for f, i in sorted(self.items) if f == oldest]
            self.items = {k: v for k, v in self.items.items() if k[0] != oldest}
        pinned = (frame, self.PINNED)
        if row["action"] == "clear":
            self.items.pop(pinned, None)
            outcome = "cleared"
        elif row["action"] == "maintain":
            before, (count, characters) = self.items.get(pinned), self._size(pinned)
            if before and before[5] == row["item"]:
                outcome = "unchanged"
            elif count + 1 > self.most_items or characters + row["size"] > self.most_characters:
                outcome = "refused"
            else:
                self.items[pinned] = (1.0, before[1] if before else at, at, row["size"], None, row["item"])
                outcome = "updated"
        else:
            own, activation = (frame, row["item"]), min(1.0, max(0.0, row["activation"]))
            before = self.items.get(own)
            if before:
                self.items[own] = (max(before[0], activation), before[1], at, *before[3:])
                outcome = "renewed"
            else:
                self.items[own] = (activation, at, at, row["size"], row["ttl"], None)
                outcome = "added"
                gone += self._trim()
        live = sum(f == frame and (not v[4] or v[1] + v[4] > at) for (f, _), v in self.items.items())
        count, characters = self._size()
        return [(key, row["event_id"], outcome, gone, count, characters, len(self.frames), live)]

    def _trim(self) -> list[str]:
        gone, (count, characters) = [], self._size()
        if count <= self.most_items and characters <= self.most_characters:
            return gone
        for k in sorted((k for k in self.items if k[1] != self.PINNED), key=lambda k: (self.items[k][0], self.items[k][2], k)):
            if count <= self.most_items and characters <= self.most_characters:
                break
            count, characters = count - 1, characters - self.items.pop(k)[3]
            gone.append(f"{k[0]}/{k[1]}")
        return gone


def working_set_stream(stream: DataFrame, delay: str, items: int = 256, characters: int = 100_000, frames: int = 16) -> DataFrame:
    """One row for every row of the session's log, once the watermark has passed it: what became of it, what
    it pushed out, and how full the set is. ``stream``: session, time, event_id, action (observe, maintain,
    clear), frame, item, size (characters), activation, ttl (microseconds or null)."""
    return with_state(stream, "session", "time", delay, WorkingSet(items, characters, frames), WorkingSet.OUTPUT)


class TaskWindow(InOrder):
    """The two latest different substantive prompts of a session."""

    OUTPUT = "session bigint, ordinal bigint, continued boolean, context string, substantive boolean"

    def __init__(self):
        super().__init__("at bigint, ordinal bigint, anchor string, again boolean", "ordinal", self.OUTPUT)

    def opened(self, handle):
        self.kept = handle.getValueState("anchors", "latest string, prior string")

    def load(self):
        self.latest, self.prior = self.kept.get() or (None, None)

    def save(self):
        self.kept.update((self.latest, self.prior))

    def apply(self, key, row):
        continued = self.prior is not None and row["again"]  # null for a prompt that is null, as in the batch twin
        out = (key, row["ordinal"], continued, self.prior if continued else None, row["anchor"] is not None)
        if row["anchor"] is not None and row["anchor"] != self.latest:
            self.prior = row["anchor"] if self.latest is None else f"{self.latest}\n{row['anchor']}"
            self.latest = row["anchor"]
        return [out]


def task_window_stream(turns: DataFrame, delay: str) -> DataFrame:
    """Stream form of ``views.task_window``. ``turns``: session, time, ordinal, prompt."""
    anchor, again = views.prompt_kind(c("prompt"))
    staged = turns.select("session", "time", "ordinal", anchor.alias("anchor"), again.alias("again"))
    return with_state(staged, "session", "time", delay, TaskWindow(), TaskWindow.OUTPUT)
