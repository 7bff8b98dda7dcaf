"""Operators with state rows of their own and timers: matching, complete sets, repeats.

State lives in RocksDB, a row for each stretch of time (or content) of a key, so a busy key rewrites only what a batch touches, and
event-time timers remove what no later message can need, even if the key stays silent.  Rows of a micro-batch are taken in the
order of their time, so that many small batches in order give the rows of one large batch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that state rows and timers need, for the streams that start inside; the session's own comes back."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, own)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["us", "event_id"])


class Stretches:
    """What waits on one side, in stretches of time: a state row each, read when first touched and written back if changed."""

    def __init__(self, state, side: str, width: int):
        self.state, self.side, self.width = state, side, width
        self.read, self.changed = {}, set()

    def at(self, b: int) -> list:
        if b not in self.read:
            held = self.state.getValue((self.side, b)) if self.state.containsKey((self.side, b)) else None
            self.read[b] = [] if held is None else [tuple(x) for x in zip(*held, strict=True)]
        return self.read[b]

    def put(self, item: tuple) -> int:
        b = item[0] // self.width
        insort(self.at(b), item)
        self.changed.add(b)
        return b

    def take_first(self, low: int, high: int) -> tuple | None:
        """Removes the earliest item of [low, high]."""
        for b in range(low // self.width, high // self.width + 1):
            items = self.at(b)
            k = bisect_left(items, (low,))
            if k < len(items):
                if items[k][0] > high:
                    return None
                self.changed.add(b)
                return items.pop(k)
        return None

    def write(self) -> None:
        for b in self.changed:
            if self.read[b]:
                self.state.updateValue((self.side, b), tuple(list(x) for x in zip(*self.read[b], strict=True)))
            elif self.state.containsKey((self.side, b)):
                self.state.removeKey((self.side, b))


class GreedyMatcher(StatefulProcessor):
    """Results and traces of a key wait for each other; each takes the earliest of the other kind within ``seconds``.

    A message that repeats one of its kind and content less than ``repeat`` seconds after the last one kept is left out (0: none
    is).  An item waits ``keep`` seconds of event time at least, then a timer removes its stretch.
    """

    def __init__(self, seconds: float, keep: float, kind: str, repeat: float = 0.0):
        self.width, self.keep, self.kind, self.repeat = int(seconds * 1e6), int(keep * 1e6), kind, int(repeat * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "side string, stretch bigint", f"us array<bigint>, id array<bigint>, value array<{self.kind}>")
        self.seen = handle.getMapState("seen", "side string, content bigint", "us bigint")
        self.seen_in = handle.getMapState("seen_in", "stretch bigint", "side array<string>, content array<bigint>")

    def _ends(self, b: int) -> int:
        return ((b + 1) * self.width + self.keep) // 1000 + 1

    def _ended(self, ms: int) -> range:
        """The stretches whose timer is set to that time: one, or several that are shorter than its milliseconds."""
        low = (ms - 1) * 1000 - self.keep
        return range(-(-low // self.width) - 1, (low + 999) // self.width)

    def _last(self, known: dict, of: tuple) -> int | None:
        if of not in known:
            known[of] = self.seen.getValue(of)[0] if self.seen.containsKey(of) else None
        return known[of]

    def _write_seen(self, known: dict, kept: dict[int, set]) -> None:
        for of in set().union(*kept.values()):
            self.seen.updateValue(of, (known[of],))
        for b, held in kept.items():
            before = zip(*self.seen_in.getValue((b,)), strict=True) if self.seen_in.containsKey((b,)) else ()
            self.seen_in.updateValue((b,), tuple(list(x) for x in zip(*sorted(held.union(map(tuple, before))), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sides = {k: Stretches(self.waiting, k, self.width) for k in ("result", "trace")}
        new, out, due, known, kept = _ordered(rows), [], set(), {}, {}
        contents = new["content"].tolist() if self.repeat else [0] * len(new)
        for kind, i, t, v, content in zip(*(new[c].tolist() for c in ("kind", "event_id", "us", "value")), contents, strict=True):
            if self.repeat:
                last = self._last(known, (kind, content))
                if last is not None and t - last < self.repeat:
                    continue
                known[kind, content] = t
                kept.setdefault(t // self.width, set()).add((kind, content))
                due.add(t // self.width)
            mate = sides["trace" if kind == "result" else "result"].take_first(t - self.width, t + self.width)
            if mate is None:
                due.add(sides[kind].put((t, i, v)))
            else:
                a, b = ((t, i, v), mate) if kind == "result" else (mate, (t, i, v))
                out.append((*key, a[1], b[1], a[2], b[2], a[0], b[0]))
        for s in sides.values():
            s.write()
        self._write_seen(known, kept)
        for b in due:
            self.handle.registerTimer(self._ends(b))
        yield pd.DataFrame(out, columns=["tool", "result", "trace", "result_value", "trace_value", "result_us", "trace_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for b in self._ended(expiredTimerInfo.getExpiryTimeInMs()):  # only these, however much else the key holds
            for side in ("result", "trace"):
                if self.waiting.containsKey((side, b)):
                    self.waiting.removeKey((side, b))
            if self.repeat and self.seen_in.containsKey((b,)):
                for of in zip(*self.seen_in.getValue((b,)), strict=True):
                    if self.seen.containsKey(of) and self.seen.getValue(of)[0] // self.width == b:
                        self.seen.removeKey(of)
                self.seen_in.removeKey((b,))
        yield from ()

    def close(self) -> None:
        pass


def match_greedily(messages: DataFrame, seconds: float, keep: float = 300.0, repeat: float = 0.0) -> DataFrame:
    """One-to-one matches of a stream with a watermark (columns tool, kind, event_id, ts, value; content with ``repeat``)."""
    kinds = dict(messages.dtypes)
    content = F.col("content") if repeat else F.lit(0).cast("bigint").alias("content")
    x = messages.where(F.col("kind").isin("result", "trace"))
    x = x.select("tool", "kind", "event_id", F.unix_micros("ts").alias("us"), "value", content, "ts")
    out = f"tool {kinds['tool']}, result bigint, trace bigint, result_value {kinds['value']}, trace_value {kinds['value']}, result_us bigint, trace_us bigint"
    how = GreedyMatcher(seconds, keep, kinds["value"], repeat)
    return x.groupBy("tool").transformWithStateInPandas(how, out, "append", "eventTime")


class CompleteSets(StatefulProcessor):
    """The latest value of each required kind of a key; a row once all are there, then the key starts anew.

    A set that is not complete ``timeout`` seconds after its first message is given up, by the next message or by a timer.
    """

    def __init__(self, required: list[str], timeout: float):
        self.required, self.timeout = required, int(timeout * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "kind string", "value double")
        self.since = handle.getValueState("since", "us bigint")

    def _clear(self) -> None:
        self.latest.clear()
        self.since.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, new = [], _ordered(rows)
        since = self.since.get()[0] if self.since.exists() else None
        held = {k[0]: v[0] for k, v in self.latest.iterator()} if since is not None else {}
        for kind, t, value in zip(*(new[c].tolist() for c in ("kind", "us", "value")), strict=True):
            if since is not None and t - since > self.timeout:
                held, since = {}, None
            held[kind] = value
            since = t if since is None else since
            if len(held) == len(self.required):
                out.append([*key, t, *(held[k] for k in self.required)])
                held, since = {}, None
        self._clear()
        if held:
            self.since.update((since,))
            for k, v in held.items():
                self.latest.updateValue((k,), (v,))
            self.handle.registerTimer((since + self.timeout) // 1000 + 1)
        yield pd.DataFrame(out, columns=["tool", "us", *self.required])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.since.exists() and (self.since.get()[0] + self.timeout) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self._clear()
        yield pd.DataFrame([], columns=["tool", "us", *self.required])

    def close(self) -> None:
        pass


def complete_sets(messages: DataFrame, required: list[str], timeout: float = 60.0) -> DataFrame:
    """Complete sets of a stream with a watermark (columns tool, kind, event_id, ts, value)."""
    x = messages.where(F.col("kind").isin(required)).select("tool", "kind", "event_id", F.unix_micros("ts").alias("us"), "value", "ts")
    out = f"tool {dict(messages.dtypes)['tool']}, us bigint, " + ", ".join(f"{k} double" for k in required)
    return x.groupBy("tool").transformWithStateInPandas(CompleteSets(required, timeout), out, "append", "eventTime")


class Repeats(StatefulProcessor):
    """Repeats of a key's content less than ``seconds`` after the last message that counts, by policy.

    ignore: the repeat is left out and the first counts on.  replace: the repeat takes the place of the one before it, whose
    id comes as ``replaces``, and counts from then on.  error: the first repeat ends the stream.
    """

    def __init__(self, policy: str, seconds: float):
        self.policy, self.step = policy, int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.last.get() if self.last.exists() else None
        new = _ordered(rows)
        for i, t in zip(new["event_id"].tolist(), new["us"].tolist(), strict=True):
            repeat = last is not None and t - last[0] < self.step
            if repeat and self.policy == "error":
                raise ValueError(f"message {i} repeats message {last[1]}")
            if repeat and self.policy == "ignore":
                continue
            out.append((i, t, last[1] if repeat else None))
            last = (t, i)
        self.last.update(tuple(last))
        self.handle.registerTimer((last[0] + self.step) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "us", "replaces"]).astype({"replaces": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and (self.last.get()[0] + self.step) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame([], columns=["event_id", "us", "replaces"]).astype({"replaces": "Int64"})

    def close(self) -> None:
        pass


def repeats(messages: DataFrame, keys: list[str], policy: str = "ignore", seconds: float = 1.0) -> DataFrame:
    """Messages of a stream with a watermark (columns event_id, ts and ``keys``) that count: (event_id, us, replaces).

    Null keys equal each other. With ``replace`` a row whose id comes later as ``replaces`` no longer holds.
    """
    if policy not in ("ignore", "replace", "error"):
        raise ValueError(f"no such policy: {policy}")
    x = messages.select(*keys, "event_id", F.unix_micros("ts").alias("us"), "ts")
    out = "event_id bigint, us bigint, replaces bigint"
    return x.groupBy(*keys).transformWithStateInPandas(Repeats(policy, seconds), out, "append", "eventTime")
