"""Event-time replay for ``transformWithStateInPandas``, and the policies it drives.

Rows of a key wait in state until the watermark has passed their time slot, so a
policy sees each row once and in time order however files arrive; rows later
than the watermark are dropped and counted by Spark before they reach it.  A
policy is a function of one slot of ordered rows and the few numbers carried
from the slot before.  Policies are written as the batch forms in
``framesleuth.operators.telemetry`` are: a row that switches a state leaves a
marker, and the state of a row is the last marker so far.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000
FRESH_US = 15 * SECOND
HEARTBEAT_US = 90 * SECOND
#: Stands for "never" among carried times.
NEVER = -(1 << 62)


class Policy(NamedTuple):
    """A live operator: its output columns, what it carries between slots, and one step.

    ``step(rows, carried)`` gets the rows of one slot in order of group, ``at_us``
    and ``order``, and for each group what was carried.  It returns the output
    columns, without keys but with ``_row``, the row each comes from, and for each
    group what to carry.  ``_group`` numbers the groups; without it all rows are one.
    """

    output: str
    carries: str
    start: tuple
    step: Callable
    order: tuple[str, ...] = ()


class Groups:
    """Where the groups of ordered rows begin and end, and the group of each row."""

    def __init__(self, rows: pd.DataFrame):
        of = rows["_group"].to_numpy() if "_group" in rows.columns else np.zeros(len(rows), "i8")
        self.starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        self.ends = np.concatenate([self.starts[1:], [len(of)]]) - 1
        self.of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts + 1)

    def spread(self, values):
        """A value for each group, or one for all, at each row."""
        return np.broadcast_to(values, len(self.starts))[self.of]


def _pack(rows) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(parts: list[bytes]) -> pd.DataFrame:
    import pyarrow as pa

    return pd.concat([pa.ipc.open_stream(p).read_all().to_pandas() for p in parts], ignore_index=True)


def _column(values) -> np.ndarray:
    """Numbers and flags as they are, anything else (texts, lists) as objects."""
    values = list(values)
    if values and not isinstance(values[0], (str, list, np.ndarray)):
        return np.asarray(values)
    out = np.empty(len(values), object)
    out[:] = [list(v) if isinstance(v, np.ndarray) else v for v in values]
    return out


class Replay(StatefulProcessor):
    """Releases rows slot by slot, in event-time order, to a policy; many keys at a time.

    The state of a bucket of keys holds the packed rows of every slot not yet
    passed by the watermark, in parts as they came, and what the policy carries
    for each key.  A slot of a bucket is the most that is sorted.  The bits of a
    negative bucket tell which keys are null (see ``jobs.replay``).
    """

    def __init__(self, policy: Policy, keys: tuple[str, ...], slot_us: int):
        self.policy, self.keys, self.slot_us = policy, list(keys), slot_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "rows binary")
        self.progress = handle.getValueState("progress", "parts long, released long")
        self.carried = handle.getValueState("carried", "rows binary")

    def _progress(self) -> tuple[int, int]:
        return tuple(self.progress.get()) if self.progress.exists() else (0, NEVER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        (parts, released), timed = self._progress(), set()
        for frame in rows:
            slots = frame["at_us"].to_numpy() // self.slot_us
            order = np.argsort(slots, kind="stable")
            table, slots = pa.Table.from_pandas(frame.drop(columns="_bucket", errors="ignore").iloc[order], preserve_index=False), slots[order]
            found, begins = np.unique(slots, return_index=True)
            for slot, begin, end in zip(found.tolist(), begins.tolist(), [*begins.tolist()[1:], len(slots)]):
                self.waiting.updateValue((slot, parts), (_pack(table.slice(begin, end - begin)),))
                parts += 1
            timed.update(found.tolist())
        for slot in timed:
            self.handle.registerTimer((slot + 1) * self.slot_us // 1000)
        self.progress.update((parts, released))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts, released = self._progress()
        # The first timer of a batch releases all that the watermark has passed.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        if upto <= released:
            return
        due: dict[int, list[int]] = {}
        for slot, part in self.waiting.keys():
            if (slot + 1) * self.slot_us <= upto:
                due.setdefault(slot, []).append(part)
        held, names = None, [c.split()[0] for c in self.policy.carries.split(", ")]
        if self.carried.exists():
            held = _unpack([self.carried.get()[0]])
        known = held[self.keys] if held is not None else None
        carried = [_column(held[n]) for n in names] if held is not None else [_column([]) for _ in names]
        for slot in sorted(due):
            rows = _unpack([self.waiting.getValue((slot, part))[0] for part in sorted(due[slot])])
            for part in due[slot]:
                self.waiting.removeKey((slot, part))
            n_known = 0 if known is None else len(known)
            both = rows[self.keys] if known is None else pd.concat([known, rows[self.keys]], ignore_index=True)
            # Known keys come first and once each, so they are numbered by their places.
            codes = both.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()[n_known:]
            rows = rows.assign(_group=codes).sort_values(["_group", "at_us", *self.policy.order], kind="mergesort", ignore_index=True)
            groups = Groups(rows)
            here = rows["_group"].to_numpy()[groups.starts]
            fresh = here >= n_known
            if fresh.any():
                first = rows[self.keys].iloc[groups.starts[fresh]]
                known = first.reset_index(drop=True) if known is None else pd.concat([known, first], ignore_index=True)
                carried = [_column([*c, *([s] * int(fresh.sum()))]) for c, s in zip(carried, self.policy.start)]
            out, after = self.policy.step(rows, tuple(c[here] for c in carried))
            for column, values in zip(carried, after):
                column[here] = _column(values)
            places = out.pop("_row")
            if len(places):
                null = [key[0] < 0 and -key[0] >> i & 1 for i in range(len(self.keys))]
                yield pd.DataFrame({k: np.full(len(places), None) if n else rows[k].to_numpy()[places] for k, n in zip(self.keys, null)} | out)
        self.progress.update((parts, upto))
        if known is not None and due:
            import pyarrow as pa

            table = pa.Table.from_pandas(known.assign(**{n: list(c) for n, c in zip(names, carried)}), preserve_index=False)
            self.carried.update((_pack(table),))

    def close(self) -> None:
        pass


def last_known(values, marked, before, groups):
    """Value at the group's last marked row so far, this one included; ``before`` where none is."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    return np.where(at >= groups.starts[groups.of], np.asarray(values)[at], groups.spread(before))


def one_before(values, before, groups):
    """Value of the row before; ``before`` for the first of a group."""
    out = np.concatenate([values[:1], values[:-1]])
    out[groups.starts] = before
    return out


def _flags(rows: pd.DataFrame, *names: str):
    return [rows[n].to_numpy(dtype=bool) for n in names]


def gpu_yield(sustained_us: int = 5 * SECOND, cooldown_us: int = 60 * SECOND) -> Policy:
    """Rows ``usable, external`` to ``at_us, state, pause``."""

    def step(rows, carried):
        was_busy, busy_at, since, pausing = carried
        at, (usable, external) = rows["at_us"].to_numpy(), _flags(rows, "usable", "external")
        busy = usable & external
        groups = Groups(rows)
        was = last_known(busy, usable, was_busy, groups)
        begins = busy & ~one_before(was, was_busy, groups).astype(bool)
        last_busy, since = last_known(at, busy, busy_at, groups), last_known(at, begins, since, groups)
        on, off = busy & (at - since >= sustained_us), usable & ~busy & (at - last_busy >= cooldown_us)
        held = last_known(on, on | off, pausing, groups).astype(bool)
        state = np.select([~usable, busy & held, busy, held], ["unavailable", "yielding", "busy", "cooldown"], "available")
        out = {"_row": np.arange(len(at)), "at_us": at, "state": state, "pause": np.isin(state, ["yielding", "cooldown"])}
        return out, tuple(c[groups.ends] for c in (was, last_busy, since, held))

    return Policy("at_us long, state string, pause boolean", "was_busy boolean, busy_at long, since long, pausing boolean", (False, NEVER, NEVER, False), step, ("ordinal",))


def cpu_yield(busy_us: int = 10 * SECOND, quiet_us: int = 60 * SECOND, fresh_us: int = FRESH_US) -> Policy:
    """Rows ``sane, busy, quiet`` to ``at_us, state``."""

    def step(rows, carried):
        before_at, before_ok, before_busy, before_quiet, busy_from, quiet_from, pausing = carried
        at, (ok, busy, quiet) = rows["at_us"].to_numpy(), _flags(rows, "sane", "busy", "quiet")
        groups = Groups(rows)
        gap = at - one_before(at, before_at, groups)
        afresh = ok & ~(one_before(ok, before_ok, groups).astype(bool) & (gap >= 0) & (gap <= fresh_us))
        froms = []
        for flag, before, start in ((busy, before_busy, busy_from), (quiet, before_quiet, quiet_from)):
            froms.append(last_known(at, flag & (afresh | ~one_before(flag, before, groups).astype(bool)), start, groups))
        on, off = busy & (at - froms[0] >= busy_us), quiet & (at - froms[1] >= quiet_us)
        held = last_known(on, on | off | afresh, pausing, groups).astype(bool)
        state = np.select([~ok, held, busy], ["unavailable", "yielding", "busy"], "available")
        return {"_row": np.arange(len(at)), "at_us": at, "state": state}, tuple(c[groups.ends] for c in (at, ok, busy, quiet, *froms, held))

    carries = "before_at long, before_ok boolean, before_busy boolean, before_quiet boolean, busy_from long, quiet_from long, pausing boolean"
    return Policy("at_us long, state string", carries, (NEVER, False, False, False, NEVER, NEVER, False), step, ("ordinal",))


def sustained_gate(hold_us: int = 30 * SECOND, gap_us: int = 10 * SECOND, cooldown_us: int = 60 * SECOND) -> Policy:
    """Rows ``healthy`` to ``at_us, open``."""

    def step(rows, carried):
        before_at, before_ok, since, bad_at = carried
        at, (ok,) = rows["at_us"].to_numpy(), _flags(rows, "healthy")
        groups = Groups(rows)
        gap = at - one_before(at, before_at, groups)
        begins = ok & ~(one_before(ok, before_ok, groups).astype(bool) & (gap >= 0) & (gap <= gap_us))
        since, bad = last_known(at, begins, since, groups), last_known(at, ~ok, bad_at, groups)
        opened = ok & (at - since >= hold_us) & (at - bad >= cooldown_us)
        return {"_row": np.arange(len(at)), "at_us": at, "open": opened}, tuple(c[groups.ends] for c in (at, ok, since, bad))

    return Policy("at_us long, open boolean", "before_at long, before_ok boolean, since long, bad_at long", (NEVER, False, NEVER, NEVER), step, ("ordinal",))


def stage_seconds() -> Policy:
    """Rows ``category``; each interval is charged to the category it began in.

    Output ``at_us, category, us`` has one row for each interval, at its end.
    """

    def step(rows, carried):
        before_at, before = carried
        at, category = rows["at_us"].to_numpy(), rows["category"].to_numpy(object)
        groups = Groups(rows)
        begun, kind = one_before(at, before_at, groups), one_before(category, before, groups)
        known = begun != NEVER
        return {"_row": np.flatnonzero(known), "at_us": at[known], "category": kind[known], "us": (at - begun)[known]}, (at[groups.ends], category[groups.ends])

    return Policy("at_us long, category string, us long", "before_at long, before string", (NEVER, ""), step, ("ordinal",))


def throughput(kept: int = 8, least: int = 3) -> Policy:
    """Rows ``work, elapsed, overlap``; numbers of rates held and the gain of paired work, once a slot."""

    def step(rows, carried):
        work, elapsed, overlap = (rows[n].to_numpy("f8") for n in ("work", "elapsed", "overlap"))
        usable = (work > 0) & (elapsed >= 2) & (overlap <= 1) & ((overlap <= 0) | (overlap >= 0.8))
        rates, groups, held = np.divide(work, elapsed, out=np.zeros(len(work)), where=elapsed > 0), Groups(rows), []
        for before, kind in zip(carried, (overlap >= 0.8, overlap <= 0)):
            take = np.flatnonzero(usable & kind)
            # A row of the slot belongs to one group; ``cuts`` are where the taken rows of each begin.
            cuts = np.searchsorted(take, groups.starts)
            kept_now = np.split(rates[take], cuts[1:])
            before = list(before) if len(before) else [[]] * len(groups.starts)
            held.append([[*b, *n.tolist()][-kept:] for b, n in zip(before, kept_now)])
        gains = [2 * np.median(p) / np.median(q) if min(len(p), len(q)) >= least else None for p, q in zip(*held)]
        out = {"_row": groups.ends, "at_us": rows["at_us"].to_numpy()[groups.ends], "paired": [len(p) for p in held[0]], "single": [len(q) for q in held[1]], "gain": pd.Series(gains, dtype="float64")}
        return out, tuple(held)

    return Policy("at_us long, paired long, single long, gain double", "paired array<double>, single array<double>", ([], []), step, ("ordinal",))


def activity() -> Policy:
    """Rows ``ordinal, value``; those above everything before them and above zero."""

    def step(rows, carried):
        value, groups = rows["value"].to_numpy(), Groups(rows)
        before = groups.spread(carried[0])
        top = np.maximum(pd.Series(value).groupby(groups.of).cummax().to_numpy(), before)
        new = value > one_before(top, carried[0], groups)
        return {"_row": np.flatnonzero(new), "at_us": rows["at_us"].to_numpy()[new], "ordinal": rows["ordinal"].to_numpy()[new], "value": value[new]}, (top[groups.ends],)

    return Policy("at_us long, ordinal long, value long", "top long", (0,), step, ("ordinal",))


#: A progress line, with the name of its stage or without: fixed form.
_PROGRESS = re.compile(r"^[ \t]*(?:[A-Z]+_)?PROGRESS=([0-9]+(?:\.[0-9]+)?)[ \t]*$", re.MULTILINE)


def progress() -> Policy:
    """Rows ``ordinal, chunk`` of a log cut anywhere; per progress line its percent and its advance.

    The chunks of a slot are one text; what follows its last line feed is carried
    whole to the next slot.
    """

    def step(rows, carried):
        groups, chunks, row, percents, increments, rests, highs = Groups(rows), rows["chunk"].tolist(), [], [], [], [], []
        for begin, end, rest, top in zip(groups.starts.tolist(), groups.ends.tolist(), *(np.broadcast_to(c, len(groups.starts)).tolist() for c in carried)):
            whole, feed, rest = (rest + "".join(chunks[begin : end + 1])).rpartition("\n")
            for found in _PROGRESS.findall(whole.replace("\r\n", "\n").removesuffix("\r")):
                percent = min(100.0, float(found))
                row.append(end)
                percents.append(percent)
                increments.append(max(top, percent) - top)
                top = max(top, percent)
            rests.append(rest)
            highs.append(top)
        row = np.array(row, "i8")
        return {"_row": row, "at_us": rows["at_us"].to_numpy()[row], "percent": np.array(percents, "f8"), "increment": np.array(increments, "f8")}, (rests, highs)

    return Policy("at_us long, percent double, increment double", "rest string, top double", ("", 0.0), step, ("ordinal",))


def confirmations(ttl_us: int = 600 * SECOND) -> Policy:
    """Rows ``ordinal, action``; a confirm is accepted while its preview holds, and uses it up."""

    def step(rows, carried):
        at, ordinal, action = rows["at_us"].to_numpy(), rows["ordinal"].to_numpy(), rows["action"].to_numpy(object)
        shown, confirm = action == "preview", action == "confirm"
        # A confirm leaves "no preview" for what follows it.
        groups = Groups(rows)
        held = last_known(np.where(shown, at, NEVER), shown | confirm, carried[0], groups)
        age = at - one_before(held, carried[0], groups)
        return {"_row": np.flatnonzero(confirm), "at_us": at[confirm], "ordinal": ordinal[confirm], "accepted": (age < ttl_us)[confirm]}, (held[groups.ends],)

    return Policy("at_us long, ordinal long, accepted boolean", "shown long", (NEVER,), step, ("ordinal",))


class Heartbeats(StatefulProcessor):
    """Newest state of each job, and ``stale`` once a running job was silent for the limit of event time.

    Older beats than the newest one change nothing.
    """

    output = "job long, updated_us long, state string"

    def __init__(self, limit_us: int = HEARTBEAT_US):
        self.limit_us = limit_us

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "updated_us long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.kept.get()) if self.kept.exists() else (NEVER, "")
        for frame in rows:
            row = frame.loc[frame["at_us"].idxmax()]
            newest = max(newest, (int(row["at_us"]), str(row["state"])))
        self.kept.update(newest)
        if newest[1] == "running":
            self.handle.registerTimer((newest[0] + self.limit_us) // 1000)
        yield pd.DataFrame([(key[0], *newest)], columns=["job", "updated_us", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        updated, state = self.kept.get()
        # Timers of beats that newer ones followed have nothing to say.
        if state == "running" and (updated + self.limit_us) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((updated, "stale"))
            yield pd.DataFrame([(key[0], updated, "stale")], columns=["job", "updated_us", "state"])

    def close(self) -> None:
        pass
