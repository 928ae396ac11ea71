"""Thresholds of keys with very many events, by chunks of time that all cores fold at once.

What a chunk does depends on the last fire before it, and of that only on how many of the rows that stand open at its beginning (its tail: fewer than the
rule counts, and ten for evidence) come after it. So a chunk is a small function, from that number to its own last fire. Three passes:

1. each chunk gives its own last rows; in order, they make the tail of each chunk;
2. each chunk, with its tail, gives its function; in order, they make the last fire before each chunk;
3. each chunk, with its tail and that fire, gives its fires.

What is put in order for a key is a tail or a function for each chunk, never its events. Chunks are cut at approximate quantiles of the key's times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .chains import Events, Plan, chain_fires

HOT = 20_000_000  # events of a key that are cut in chunks; fewer are folded sooner by one task
CHUNK = 1_000_000  # events of a chunk, about
CUTS = 1000  # chunks of a key, at most
TASKS = 20_000  # of a pass, at most
KEYS = ["source_file", "key"]


def hot_keys(rows: DataFrame, hot: int = HOT, chunk: int = CHUNK) -> DataFrame | None:
    """source_file, key, cuts: the times at which keys with more than hot rows are cut; None if there are none. Written, as several passes read it."""
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    if most is None or most <= hot:
        return None
    counts = shared.written(counts.where(F.col("n") > hot), "hot-keys")
    parts = min(CUTS, max(2, most // chunk))
    cuts = F.percentile_approx("us", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))
    own = rows.join(shared.small(counts.select(*KEYS)), KEYS, "left_semi")
    return shared.written(own.groupBy(*KEYS).agg(F.array_distinct(cuts).alias("cuts")), "hot-cuts")


def _sorted(table: pa.Table, values: int) -> Events:
    us, line = table.column("us").to_numpy(), table.column("line_number").to_numpy()
    order = np.lexsort((line, us))
    return Events(us[order], line[order], table.column("mask").to_numpy()[order], [table.column(f"v{i}").combine_chunks().cast(pa.string()).take(pa.array(order)) for i in range(values)])


def _left(plan: Plan, events: Events) -> Events:
    """The rows that later ones may need if nothing fires."""
    return events.take(plan.needs(events).left(0, None)[0]) if len(events) else events


TAIL = "rule int, us array<long>, line array<long>, mask array<long>, value array<string>"
_TAIL = pa.schema([("rule", pa.int32()), ("us", pa.list_(pa.int64())), ("line", pa.list_(pa.int64())), ("mask", pa.list_(pa.int64())), ("value", pa.list_(pa.string()))])


def _tail_row(p: int, plan: Plan, tail: Events) -> dict:
    own = plan.own[0][2]
    return {"rule": p, "us": tail.us.tolist(), "line": tail.line.tolist(), "mask": tail.mask.tolist(), "value": [None] * len(tail) if own is None else tail.values[own].to_pylist()}


def _tail_of(row: dict, plan: Plan, values: int) -> Events:
    own = plan.own[0][2]
    return Events.of(row["us"], row["line"], row["mask"], [row["value"] if i == own else [None] * len(row["us"]) for i in range(values)])


def fires(rows: DataFrame, cuts: DataFrame, plans: list[Plan], values: int, batch, schema: str) -> DataFrame:
    """Fires of thresholds (plans) of the rows whose key is in cuts."""
    spread = rows.join(shared.small(cuts), KEYS)
    spread = spread.withColumn("chunk", F.size(F.filter("cuts", lambda c: c < F.col("us")))).drop("cuts")
    spread = shared.written(spread, "hot-rows")
    place = [*KEYS, "chunk"]
    # a partition for each chunk, which adaptive execution leaves as they are: a chunk is few bytes but much work
    tasks = min(TASKS, cuts.agg(F.sum(F.size("cuts") + 1)).first()[0])
    dealt = spread.repartition(tasks, *place)
    types = "source_file string, key string, chunk int"

    def headed(key: tuple, out: list[dict], shape: pa.Schema) -> pa.Table:
        names = dict(zip(place, (k.as_py() for k in key), strict=True))
        full = pa.schema([("source_file", pa.string()), ("key", pa.string()), ("chunk", pa.int32()), *shape])
        return pa.Table.from_pylist([names | row for row in out], full)

    def last_rows(key, table):
        events = _sorted(table, values)
        return headed(key, [_tail_row(p, plan, _left(plan, events)) for p, plan in enumerate(plans)], _TAIL)

    def tails(key, table):
        """The tail at the beginning of each chunk of a key, for one rule."""
        out, now = [], None
        for row in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
            plan = plans[row["rule"]]
            now = plan.start(values).rows if now is None else now
            out.append({k: row[k] for k in place} | _tail_row(row["rule"], plan, now))
            now = _left(plan, _tail_of(row, plan, values).after(now))
        return pa.Table.from_pylist(out, table.schema)

    own = dealt.groupBy(*place).applyInArrow(last_rows, f"{types}, {TAIL}")
    begin = shared.written(own.groupBy(*KEYS, "rule").applyInArrow(tails, f"{types}, {TAIL}"), "hot-tails")

    function = pa.schema([("rule", pa.int32()), ("tail_us", pa.list_(pa.int64())), ("tail_line", pa.list_(pa.int64())), ("end_us", pa.list_(pa.int64())), ("end_line", pa.list_(pa.int64()))])

    def functions(key, table, tail):
        """For each number of the tail's rows that come before the last fire (all of them, at the end): the chunk's own last fire, null for none."""
        if not table.num_rows:
            return headed(key, [], function)
        events, out = _sorted(table, values), []
        for row in tail.to_pylist():
            plan = plans[row["rule"]]
            before = _tail_of(row, plan, values)
            needs = plan.needs(all_rows := events.after(before))
            last = _last_of_chain(needs.at, needs.first)
            start = np.searchsorted(needs.first, np.arange(len(before) + 1))
            ends = [int(last[k]) if k < len(last) else None for k in start]
            pick = lambda column: [None if e is None else int(column[e]) for e in ends]  # noqa: B023, E731
            out.append({"rule": row["rule"], "tail_us": row["us"], "tail_line": row["line"], "end_us": pick(all_rows.us), "end_line": pick(all_rows.line)})
        return headed(key, out, function)

    def composed(key, table):
        """The last fire before each chunk of a key, for one rule."""
        out, last = [], None
        for row in table.sort_values("chunk").to_dict("records"):
            out.append((*(row[k] for k in place), row["rule"], *(last or (None, None))))
            tail = list(zip(row["tail_us"], row["tail_line"], strict=True))
            k = 0 if last is None else sum(t <= last for t in tail)
            if not pd.isna(row["end_us"][k]):
                last = int(row["end_us"][k]), int(row["end_line"][k])
        done = pd.DataFrame(out, columns=[*place, "rule", "fired_us", "fired_line"])
        return done.astype({"fired_us": "Int64", "fired_line": "Int64"})

    each = dealt.groupBy(*place).cogroup(begin.groupBy(*place)).applyInArrow(functions, f"{types}, rule int, tail_us array<long>, tail_line array<long>, end_us array<long>, end_line array<long>")
    entry = each.groupBy(*KEYS, "rule").applyInPandas(composed, f"{types}, rule int, fired_us long, fired_line long")
    known = begin.join(entry, [*place, "rule"])

    def found(key, table, state):
        out, names = [], tuple(k.as_py() for k in key[:2])
        events = _sorted(table, values) if table.num_rows else None
        for row in state.to_pylist() if events is not None else []:
            plan = plans[row["rule"]]
            before = _tail_of(row, plan, values)
            fired = (row["fired_us"], row["fired_line"])
            since = 0 if fired[0] is None else sum(t <= fired for t in zip(row["us"], row["line"], strict=True))
            all_rows = events.after(before)
            out += [(*names, plan.rule.id, fire) for fire in chain_fires(all_rows, plan.needs(all_rows), since)[1]]
        return pa.Table.from_batches([batch(out)]) if out else pa.Table.from_batches([], batch([("", "", "", (0, 0, 0, 0, []))]).schema)

    return dealt.groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(found, schema)


def _last_of_chain(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each event that may fire: the last fire of the chain that goes on from it. By doubling steps."""
    n = len(at)
    step = np.append(np.searchsorted(first, at, "right"), n)
    end = np.append(at, 0)
    own = np.arange(n)
    while len(own := own[step[own] < n]):
        to = step[own]
        end[own], step[own] = end[to], step[to]
    return end[:n]
