"""Rules that go through each key's rows in order of time, in batch and as streams.

A rule is a step: ``step(key, t, o, v, state) -> (columns, state, until)``. It gets a key's next rows in order as arrays
(t: time in microseconds; o: what settles equal times; v: a value) and the key's state, and gives columns of results, the
new state (a tuple, or None) and the time in milliseconds from which on the state doesn't matter any more (None: it
always does). Steps work on arrays; none loops over rows in Python but where each row depends on the last.

In batch, keys are dealt to tasks and sorted there, and a key's state goes from one Arrow batch to the next, so a long
key is never held whole. As a stream, rows wait in the state, in slices of time, until the watermark has passed their
slice, and go through the step in order then: rows that come late or out of order within the watermark get what the batch
gives them, those that come later are dropped by Spark. Timers in event time do both, and take away the state of keys
that are idle. Streams need Spark's RocksDB state store (``ROCKSDB``), which is for the session to set.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value without which Spark refuses these streams.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds of a slice of waiting rows.
SLICE_MS = 1000

Step = Callable[[str | None, np.ndarray, np.ndarray, np.ndarray, tuple | None], tuple[dict, tuple | None, int | None]]


def rows_of(df: DataFrame, key: Column, ts: str, tie: Column | None = None, value: Column | None = None) -> DataFrame:
    """(key, at, t, o, v) of a table or a stream."""
    at = F.col(ts).cast("timestamp")
    tie, value = F.lit(0) if tie is None else tie, F.lit(None) if value is None else value
    return df.select(key.cast("string").alias("key"), at.alias("at"), F.unix_micros(at).alias("t"), tie.cast("long").alias("o"), value.cast("double").alias("v")).where("at IS NOT NULL")


def in_order(rows: DataFrame, step: Step, schema: str) -> DataFrame:
    """The step over every key of a table."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode()
            code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            t, o, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            cut = np.flatnonzero(np.diff(code, prepend=code[0] - 1)).tolist() + [len(code)]
            parts: list[dict] = []
            for x, y in zip(cut, cut[1:], strict=False):
                key = None if code[x] < 0 else keys.dictionary[int(code[x])].as_py()
                if key != last:
                    last, state = key, None
                out, state, _ = step(key, t[x:y], o[x:y], v[x:y], state)
                parts.append(out)
            arrays = [pa.array(np.concatenate([p[n] for p in parts])) if n != "key" else b.column(0) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select("key", "t", "o", "v").repartition("key").sortWithinPartitions("key", "t", "o").mapInArrow(run, schema)


class InOrder(StatefulProcessor):
    """The step over every key of a stream, behind the watermark."""

    def __init__(self, step: Step, names: list[str], state: str) -> None:
        self.step, self.names, self.kind = step, names, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.kind + ", until_ bigint")
        self.waiting = handle.getMapState("waiting", "slice bigint", "t array<bigint>, o array<bigint>, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        for s, g in got.groupby(got["t"] // (1000 * SLICE_MS)):
            new = [g[c].tolist() for c in ("t", "o", "v")]
            if self.waiting.containsKey((int(s),)):
                new = [[*was, *more] for was, more in zip(self.waiting.getValue((int(s),)), new, strict=True)]
            self.waiting.updateValue((int(s),), tuple(new))
            self.handle.registerTimer((int(s) + 1) * SLICE_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        slices = sorted(k[0] for k in self.waiting.keys())
        due = [s for s in slices if (s + 1) * SLICE_MS <= now]
        held = self.held.get() if self.held.exists() else None
        if not due:
            if held is not None and held[-1] is not None and held[-1] <= now and not slices:
                self.held.clear()
            return
        parts = [self.waiting.getValue((s,)) for s in due]
        for s in due:
            self.waiting.removeKey((s,))
        t, o, v = (np.array([x for p in parts for x in p[i]], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((o, t))
        out, state, until = self.step(key[0], t[order], o[order], v[order], None if held is None else tuple(held)[:-1])
        if state is None:
            self.held.clear()
        else:
            self.held.update((*state, until))
            if until is not None:
                self.handle.registerTimer(max(until, now + 1))
        yield pd.DataFrame({n: np.repeat(np.array([key[0]], object), len(next(iter(out.values())))) if n == "key" else out[n] for n in self.names})

    def close(self) -> None:
        pass


def stream_in_order(rows: DataFrame, step: Step, schema: str, state: str, watermark: str) -> DataFrame:
    """The step over every key of a stream; ``state``: the schema of its state, as a tuple."""
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.withWatermark("at", watermark).groupBy("key").transformWithStateInPandas(InOrder(step, names, state), schema, "Append", "EventTime")


def anchors(t: np.ndarray, gap: int, since: int | None, over: bool) -> np.ndarray:
    """Where windows begin in sorted times: each with the first time that is ``gap`` (or, with ``over``, more) after the
    last one's beginning."""
    side = "right" if over else "left"
    after = np.searchsorted(t, t + gap, side).tolist()
    i = 0 if since is None else int(np.searchsorted(t, since + gap, side))
    out = []
    while i < len(t):
        out.append(i)
        i = after[i]
    return np.array(out, np.int64)


def anchored_limit(seconds: float, limit: int) -> Step:
    """A window begins with the first request after the last one ended; requests beyond the limit are turned away."""
    gap = round(seconds * 1e6)

    def step(key, t, o, v, state):
        begin, n = state or (None, 0)
        starts = anchors(t, gap, begin, False)
        i = np.arange(len(t))
        w = np.searchsorted(starts, i, "right") - 1
        own = w >= 0
        first = np.append(starts, 0)[w]
        since = np.where(own, t[first] if len(t) else 0, begin or 0)
        nth = np.where(own, i - first + 1, i + 1 + n)
        ok = nth <= limit
        out = {"t": t, "decision": ok, "remaining": (limit - np.minimum(nth, limit)).astype(np.int32), "retry_after": np.where(ok, 0.0, (gap - (t - since)) / 1e6)}
        if not len(t):
            return out, state, None
        begin, n = int(since[-1]), int(min(nth[-1], limit))
        return out, (begin, n), -(-(begin + gap) // 1000)

    return step


def stored_repeats(ttl: float, inclusive: bool) -> Step:
    """Whether a key was stored at most (or less than) ``ttl`` seconds ago; a hit doesn't renew the entry."""
    gap = round(ttl * 1e6)

    def step(key, t, o, v, state):
        starts = anchors(t, gap, state[0] if state else None, inclusive)
        hit = np.ones(len(t), bool)
        hit[starts] = False
        stored = int(t[starts[-1]]) if len(starts) else state[0] if state else None
        return {"t": t, "hit": hit}, None if stored is None else (stored,), None if stored is None else -(-(stored + gap + 1) // 1000)

    return step


#: What the value of a change feed says of its key.
INACTIVE, ACTIVE, DELETED = 0.0, 1.0, 2.0


def audit_step(key, t, o, v, state):
    """Insert where the key wasn't there, delete, and revoke where it was active and isn't; the state is the last value."""
    before = np.concatenate([[DELETED if state is None else state[0]], v[:-1]]) if len(v) else v
    action = np.select([(v == DELETED) & (before != DELETED), (v != DELETED) & (before == DELETED), (v == INACTIVE) & (before == ACTIVE)], [2, 1, 3], 0)
    last = float(v[-1]) if len(v) else None
    return {"t": t, "o": o, "action": action.astype(np.int32)}, None if last in (None, DELETED) else (last,), None


class Ranked:
    """A sorted multiset by place, in chunks of up to 2 * WIDE: adding, taking out and finding a place cost the logarithm of
    a chunk and a step over the chunks."""

    WIDE = 512

    def __init__(self) -> None:
        self.chunks: list[list[float]] = [[]]

    def _of(self, x: float, taking: bool) -> int:
        ends = [c[-1] for c in self.chunks[:-1]]
        return (bisect.bisect_left if taking else bisect.bisect_right)(ends, x)

    def add(self, x: float) -> None:
        k = self._of(x, False) if len(self.chunks) > 1 else 0
        c = self.chunks[k]
        bisect.insort(c, x)
        if len(c) > 2 * self.WIDE:
            self.chunks[k : k + 1] = [c[: self.WIDE], c[self.WIDE :]]

    def take(self, x: float) -> None:
        k = self._of(x, True) if len(self.chunks) > 1 else 0
        c = self.chunks[k]
        del c[bisect.bisect_left(c, x)]
        if not c and len(self.chunks) > 1:
            del self.chunks[k]

    def at(self, i: int) -> float:
        for c in self.chunks:
            if i < len(c):
                return c[i]
            i -= len(c)
        raise IndexError


def exact(total: float, x: float, lost: float) -> tuple[float, float]:
    """A sum and what rounding takes from it, with one number more."""
    s = total + x
    y = s - total
    return s, lost + ((total - (s - y)) + (x - y))


def rolled(held: list[float], v: np.ndarray, n: int) -> list[np.ndarray]:
    """Mean, P50, P95 and P99 (place floor(m p), the last at most) of the last n values at each of ``v``, ``held`` being
    those before."""
    values = [*held, *v.tolist()]
    lead = len(values) - len(v)
    ranked, total, lost, out = Ranked(), 0.0, 0.0, []
    for i, x in enumerate(values):
        ranked.add(x)
        total, lost = exact(total, x, lost)
        if i >= n:
            ranked.take(values[i - n])
            total, lost = exact(total, -values[i - n], lost)
        if i >= lead:
            m = min(i + 1, n)
            out.append(((total + lost) / m, *(ranked.at(min(int(m * p), m - 1)) for p in (0.5, 0.95, 0.99))))
    return list(np.array(out, float).reshape(-1, 4).T)


def rolling_step(n: int, idle_ms: int | None) -> Step:
    """``rolled`` at each row; the state is the last n - 1 values, for as long as a key isn't idle."""

    def step(key, t, o, v, state):
        held = list(state[0]) if state else []
        mean, p50, p95, p99 = rolled(held, v, n)
        every = [*held, *v.tolist()]
        last = every[max(len(every) - (n - 1), 0) :]
        return {"o": o, "mean": mean, "p50": p50, "p95": p95, "p99": p99}, (last,), None if idle_ms is None or not len(t) else int(t[-1]) // 1000 + idle_ms

    return step
