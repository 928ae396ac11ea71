"""Rules with state as chains over each key's events in order, instead of a machine that is fed event by event.

A threshold fires at an event if the earliest event that it needs (the one count events back, or the last sight of the count-th latest
value) lies in the window and after the last fire. What each event needs is found for all events at once, and as it never goes back, the next fire is one
binary search away. A sequence goes from reset to reset: the events that complete it from there, and the first event past its window, are binary
searches too. A composite goes from one fire of a part to the next. So the work in Python is that of the fires, not of the events.

Events come sorted, in batches. What a key's later events may still need of a batch is a few rows (Open): at most as many as the
rule counts, and ten for evidence. Only those are kept, so a key with most of all rows needs no more memory, and a stream keeps the same as its state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..rules.model import Rule

EVIDENCE = 10  # lines kept with a fire
SECOND = 1_000_000
NEVER = np.iinfo(np.int64).max


@dataclass
class Events:
    """Rows of one key in order: times, numbers, flags as bits, and the values that are counted."""

    us: np.ndarray
    line: np.ndarray
    mask: np.ndarray
    values: list[pa.Array]

    def __len__(self):
        return len(self.us)

    def take(self, rows) -> Events:
        return Events(self.us[rows], self.line[rows], self.mask[rows], [v.take(pa.array(rows, pa.int64())) for v in self.values])

    def slice(self, lo: int, hi: int) -> Events:
        return Events(self.us[lo:hi], self.line[lo:hi], self.mask[lo:hi], [v.slice(lo, hi - lo) for v in self.values])

    def after(self, first: Events) -> Events:
        if not len(first):
            return self
        joined = [pa.concat_arrays([a, b]) for a, b in zip(first.values, self.values, strict=True)]
        return Events(np.append(first.us, self.us), np.append(first.line, self.line), np.append(first.mask, self.mask), joined)

    @staticmethod
    def of(us, line, mask, values) -> Events:
        return Events(np.asarray(us, np.int64), np.asarray(line, np.int64), np.asarray(mask, np.int64), [pa.array(v, pa.string()) for v in values])


@dataclass
class Open:
    """What a key's later events need to know: rows, and for each part from which row it listens, a sequence's anchor, and its fire while that holds."""

    rows: Events
    since: list[int]
    anchor: list[int | None]
    held: list[tuple | None] = field(default_factory=list)


class Needs:
    """Count events of one kind, or with distinct values, within a width."""

    def __init__(self, events: Events, own: np.ndarray, count: int, width: int, values: pa.Array | None):
        self.us, self.own, self.count, self.width, self.codes, self.valued = events.us, own, count, width, None, own
        if values is not None:
            self.codes = pc.dictionary_encode(values).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            self.valued = own[self.codes[own] >= 0]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that may fire, and the first row that each needs."""
        if self.codes is None:
            at, first = self.own[self.count - 1 :], self.own[: max(0, len(self.own) - self.count + 1)]
        else:
            at, first = self._distinct()
        near = self.us[at] - self.us[first] <= self.width
        return at[near], first[near]

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """As _distinct_needs, of the rows that have count rows within the width, with values or not distinct: no others may fire. Only stretches of such rows and of what lies in their windows are gone through."""
        rows, us = self.valued, self.us[self.valued]
        many = self.count - 1 + np.flatnonzero(us[self.count - 1 :] - us[: max(0, len(us) - self.count + 1)] <= self.width)
        if not len(many):
            return many, many
        low = np.searchsorted(us, us[many] - self.width)
        new = np.flatnonzero(np.append(True, low[1:] > many[:-1]))
        found = [_distinct_needs(rows[a : b + 1], self.codes, self.count) for a, b in zip(low[new], many[np.append(new[1:], len(many)) - 1], strict=True)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    @property
    def at(self) -> np.ndarray:
        return self.pairs[0]

    @property
    def first(self) -> np.ndarray:
        return self.pairs[1]

    def next(self, since: int, anchor):
        k = int(np.searchsorted(self.first, since))
        if k == len(self.first):
            return None
        i, first = int(self.at[k]), int(self.first[k])
        hi = int(np.searchsorted(self.own, i, "right"))
        lo = max(hi - EVIDENCE, int(np.searchsorted(self.own, max(since, int(np.searchsorted(self.us, self.us[i] - self.width))))))
        return i, self.count, int(self.us[first]), self.own[lo:hi], None

    def chain(self, since: int) -> tuple:
        """All fires from a row on, at once: rows, times of the earliest needed, and from which to which of own their evidence goes."""
        first, at, n = self.first.tolist(), self.at.tolist(), len(self.at)
        fires, k = [], bisect_left(first, since)
        while k < n:
            fires.append(k)
            k = bisect_right(first, at[k], k + 1)
        rows = self.at[fires]
        hi = np.searchsorted(self.own, rows, "right")
        window = np.searchsorted(self.us, self.us[rows] - self.width)
        lo = np.searchsorted(self.own, np.maximum(window, np.append(since, rows[:-1] + 1)[: len(rows)]))
        return rows, self.us[self.first[fires]], np.maximum(lo, hi - EVIDENCE), hi

    def left(self, since: int, anchor):
        """Rows that later events may need, where the part listens since a row and has not fired after it."""
        since_now = max(since, int(np.searchsorted(self.us, self.us[-1] - self.width)))
        own = self.own[np.searchsorted(self.own, since_now) :]
        if self.codes is None:
            return own[-max(self.count - 1, EVIDENCE) :], since, anchor
        valued = self.valued[np.searchsorted(self.valued, since_now) :][::-1]
        last = np.unique(self.codes[valued], return_index=True)[1]
        return np.union1d(valued[last], own[-EVIDENCE:]), since, anchor


def _distinct_needs(rows: np.ndarray, codes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row that ends a run with count distinct codes: the row, and the latest first row of such a run."""
    own = codes[rows].tolist()
    at, first, seen, lo = [], [], {}, 0
    for hi, code in enumerate(own):
        seen[code] = seen.get(code, 0) + 1
        while len(seen) > count or len(seen) == count and seen[own[lo]] > 1:
            if seen[own[lo]] == 1:
                del seen[own[lo]]
            else:
                seen[own[lo]] -= 1
            lo += 1
        if len(seen) == count:
            at.append(hi)
            first.append(lo)
    return rows[np.array(at, np.int64)], rows[np.array(first, np.int64)]


class Steps:
    """Steps in order, each met its least number of times, within a width of the anchor: the first event since the last reset, step or not."""

    def __init__(self, events: Events, steps: list[np.ndarray], least: list[int], width: int):
        self.us, self.steps, self.least, self.width = events.us, steps, least, width

    @cached_property
    def ends(self) -> np.ndarray:
        """The row that completes the steps from each row on; NEVER if none does."""
        since = np.arange(len(self.us))
        for rows, least in zip(self.steps, self.least, strict=True):
            k = np.searchsorted(rows, since) + least - 1
            since = np.where(k < len(rows), np.append(rows, 0)[np.minimum(k, len(rows))] + 1, NEVER)
        return np.where(since < NEVER, since - 1, NEVER)

    @cached_property
    def resets(self) -> list[int]:
        """The first row past the window of each row that is an anchor."""
        return np.searchsorted(self.us, self.us + self.width, "right").tolist()

    @cached_property
    def whole(self) -> list[bool]:
        """Whether the steps are completed within the window of each row that is an anchor."""
        return (self.ends < np.array(self.resets, np.int64)).tolist()

    def _met(self, since: int) -> list[np.ndarray]:
        """The rows that meet the steps from a row on."""
        out = []
        for rows, least in zip(self.steps, self.least, strict=True):
            k = int(np.searchsorted(rows, since))
            out.append(rows[k : k + least])
            if len(out[-1]) < least:
                break
            since = int(out[-1][-1]) + 1
        return out

    def _past(self, since: int, anchor: int) -> int:
        return max(since, int(np.searchsorted(self.us, anchor + self.width, "right")))

    def next(self, since: int, anchor):
        last = int(np.searchsorted(self.ends, NEVER))  # from here on nothing is completed; ends never go back
        if anchor is not None and since < last:
            past, end = self._past(since, anchor), int(self.ends[since])
            if end < past:
                return self._fire(since, end, anchor)
            since = past
        while since < last:
            if self.whole[since]:
                return self._fire(since, int(self.ends[since]), int(self.us[since]))
            since = self.resets[since]
        return None

    def _fire(self, since: int, end: int, anchor: int):
        return end, len(self.steps), anchor, np.concatenate(self._met(since))[-EVIDENCE:], int(self.us[end])

    def left(self, since: int, anchor):
        if anchor is not None and (past := self._past(since, anchor)) < len(self.us):
            since, anchor = past, None
        if anchor is None and since < len(self.us):
            while (past := self.resets[since]) < len(self.us):
                since = past
            anchor = int(self.us[since])
        return np.concatenate(self._met(since)), since, anchor


class Plan:
    """A rule, with the places of its parts' flags and values."""

    def __init__(self, rule: Rule, own: list[tuple]):
        self.rule, self.own = rule, own
        self.parts = list(rule.parts) if rule.type == "composite" else [rule]
        self.logic = rule.logic if rule.type == "composite" else None
        self.width = (rule.seconds or 0) * SECOND

    def flags(self, mask: np.ndarray) -> list[list[np.ndarray]]:
        """For each part, for each of its steps, whether each row meets it."""
        return [[mask >> (at + i) & 1 for i in range(bits.bit_length())] for at, bits, _ in self.own]

    def least(self, j: int) -> list[int]:
        part = self.parts[j]
        return [int(s.get("min_count", 1)) for s in part.steps] if part.type == "sequence" else [part.count or 1]

    def may_fire(self, mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which runs of rows, each of one whole key, have enough rows of each kind."""
        each = [np.logical_and.reduce([np.add.reduceat(f, starts) >= n for f, n in zip(flags, self.least(j), strict=True)]) for j, flags in enumerate(self.flags(mask))]
        return (np.logical_or if self.logic == "OR" else np.logical_and).reduce(each)

    def _bound(self, events: Events):
        out = []
        for j, flags in enumerate(self.flags(events.mask)):
            part, rows = self.parts[j], [np.flatnonzero(f) for f in flags]
            width = (part.seconds or 0) * SECOND
            if part.type == "sequence":
                out.append(Steps(events, rows, self.least(j), width))
            else:
                out.append(Needs(events, rows[0], part.count or 1, width, None if self.own[j][2] is None else events.values[self.own[j][2]]))
        return out

    def start(self, values: int) -> Open:
        n = len(self.parts)
        return Open(Events.of([], [], [], [[] for _ in range(values)]), [0] * n, [None] * n, [None] * n)

    def run(self, more: Events, state: Open, ends: bool = False) -> tuple[list[tuple], Open | None]:
        """Fires at the events after those of the state: line_number, us, event_count, first_us, evidence; and the state after them, none where the key ends."""
        if not len(more):
            return [], state
        events = more.after(state.rows)
        parts = self._bound(events)
        since, anchor, held = list(state.since), list(state.anchor), list(state.held)
        fires = self._all(events, parts, since, anchor, held) if self.logic == "AND" else self._each(events, parts, since, anchor)
        if ends:
            return fires, None
        keep = []
        for j, part in enumerate(parts):
            if held[j] is None:
                rows, since[j], anchor[j] = part.left(since[j], anchor[j]) if since[j] < len(events) else (np.zeros(0, np.int64), since[j], anchor[j])
                keep.append(rows)
        rows = np.unique(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
        return fires, Open(events.take(rows), [int(np.searchsorted(rows, s)) for s in since], anchor, held)

    def needs(self, events: Events) -> Needs:
        """Of a threshold: what each of the events needs."""
        return self._bound(events)[0]

    def _lines(self, events: Events, part: int, rows: np.ndarray) -> list[int]:
        """A pattern shows no evidence beside the event itself."""
        return [] if self.parts[part].type == "regex" else events.line[rows].tolist()

    def _each(self, events, parts, since, anchor) -> list[tuple]:
        """Every fire of every part; those at one event are one fire of a composite."""
        if not self.logic and isinstance(parts[0], Needs):
            rows, fires = chain_fires(events, parts[0], since[0])
            since[0] = int(rows[-1]) + 1 if len(rows) else since[0]
            return fires
        found: dict[int, list] = {}
        for j, part in enumerate(parts):
            while since[j] < len(events) and (hit := part.next(since[j], anchor[j])):
                at, count, first, rows, anchor[j] = hit
                found.setdefault(at, []).append((count, first, self._lines(events, j, rows)))
                since[j] = at + 1
        return [(int(events.line[at]), int(events.us[at]), len(own) if self.logic else own[0][0], min(x[1] for x in own), [y for x in own for y in x[2]][-EVIDENCE:]) for at, own in sorted(found.items())]

    def _all(self, events, parts, since, anchor, held) -> list[tuple]:
        """Fires when all parts hold one: a part that fires holds it, deaf, until all do or until the window after it has passed."""
        n, out, ahead = len(events), [], {}
        while True:
            for j, part in enumerate(parts):
                if held[j] is None and j not in ahead:
                    ahead[j] = (part.next(since[j], anchor[j]) if since[j] < n else None) or (NEVER,)
            at = min((ahead[j][0] for j in range(len(parts)) if held[j] is None), default=NEVER)
            ends = {j: max(since[j], int(np.searchsorted(events.us, h[0] + self.width, "right"))) for j, h in enumerate(held) if h is not None}
            first_end = min(ends.values(), default=n)
            if first_end < n and first_end <= at:
                for j, end in ends.items():
                    if end == first_end:
                        held[j], since[j] = None, end
                        ahead.pop(j, None)
                continue
            if at == NEVER:
                return out
            turn = 1 + max((h[1] for h in held if h is not None), default=0)
            for j in range(len(parts)):
                if held[j] is None and ahead[j][0] == at:
                    _, _, first, rows, anchor[j] = ahead.pop(j)
                    held[j], since[j] = (int(events.us[at]), turn, first, self._lines(events, j, rows)), at + 1
            if None not in held:
                own = sorted(range(len(parts)), key=lambda j: (held[j][1], j))
                out.append((int(events.line[at]), int(events.us[at]), len(parts), min(h[2] for h in held), [y for j in own for y in held[j][3]][-EVIDENCE:]))
                held[:] = [None] * len(parts)
                since[:] = [at + 1] * len(parts)
                ahead.clear()


def chain_fires(events: Events, needs: Needs, since: int) -> tuple[np.ndarray, list[tuple]]:
    """Rows and fires of a threshold that listens since a row."""
    rows, first, lo, hi = needs.chain(since)
    lines = events.line[needs.own].tolist() if len(rows) else []
    evidence = [lines[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return rows, list(zip(events.line[rows].tolist(), events.us[rows].tolist(), [needs.count] * len(rows), first.tolist(), evidence, strict=True))


def runs_of(columns: list[pa.Array]) -> np.ndarray:
    """Where each run of rows with equal values begins; null equals null."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        codes = pc.dictionary_encode(c).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def key_at(columns: list[pa.Array], row: int) -> tuple:
    return tuple(c[row].as_py() for c in columns)


def scanned(batches, keys: list[str], plans: list[Plan], values: int):
    """Fires of sorted batches (keys, us, line_number, mask, v0, v1, ...), as lists of (key values, rule id, fire) for each batch."""
    now, states = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        rows = Events(*(batch.column(c).to_numpy() for c in ("us", "line_number", "mask")), [batch.column(f"v{i}") for i in range(values)])
        starts = runs_of(columns)
        ends = np.append(starts[1:], len(rows))
        goes_on = key_at(columns, 0) == now
        if not goes_on:
            states = {}
        out = []
        last = len(starts) - 1
        for p, plan in enumerate(plans):
            may = plan.may_fire(rows.mask, starts)
            # a key that began before or that may go on is looked at whatever it has
            for g in np.flatnonzero(may | (np.arange(last + 1) == last) | (goes_on & (np.arange(last + 1) == 0))):
                state = states.get(p) if g == 0 else None
                fires, state = plan.run(rows.slice(starts[g], ends[g]), state or plan.start(values), g < last)
                if fires:
                    key = key_at(columns, int(starts[g]))
                    out += [(*key, plan.rule.id, f) for f in fires]
                if g == last:
                    states[p] = state
        now = key_at(columns, int(starts[-1]))
        yield out


class Bursts:
    """Anchored windows: the first row of a key, then the first that is more than width after the one kept last."""

    def __init__(self, width: int):
        self.width, self.kept = width, None

    def kept_of(self, us: np.ndarray) -> np.ndarray:
        """Which row is kept for each row; -1 for the one kept before these."""
        rows, at = [], 0
        if self.kept is not None:
            at = int(np.searchsorted(us, self.kept + self.width, "right"))
        while at < len(us):
            rows.append(at)
            self.kept = int(us[at])
            at = int(np.searchsorted(us, self.kept + self.width, "right"))
        rows = np.array(rows, np.int64)
        place = np.searchsorted(rows, np.arange(len(us)), "right") - 1
        return np.where(place < 0, -1, rows[place]) if len(rows) else np.full(len(us), -1)
