"""Operators with state of their own for each key: ordered token streams, caches with a bound.

Both hold what they need in a state store and are woken by event-time timers.
Caches need the RocksDB state store; :func:`loomery.streaming.flows.run_once`
sets it for the streams it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import squash


@dataclass(slots=True)
class Request:
    """What is known of a request: the next ``seq`` and place, the last sources, when it is closed or forgotten, events that came too early."""

    wake: int
    next: int = 0
    place: int = 0
    closed: bool = False
    sources: str | None = None
    waiting: dict[int, tuple[str, str | None]] = field(default_factory=dict)

    def close(self, content: str | None) -> list[tuple]:
        out = ([("sources", self.sources)] if self.sources is not None else []) + [("done", content)]
        self.closed, self.sources, self.waiting = True, None, {}
        return out

    def ready(self) -> list[tuple]:
        """(type, content) of what can leave now."""
        out: list[tuple] = []
        while self.next in self.waiting:
            kind, content = self.waiting.pop(self.next)
            self.next += 1
            if kind == "sources":
                self.sources = content
            elif kind == "done":
                return out + self.close(content)
            else:
                out.append((kind, content))
        return out

    def rest(self) -> list[tuple]:
        """(type, content) of what leaves in the end, without the missing events."""
        out: list[tuple] = []
        for _, (kind, content) in sorted(self.waiting.items()):
            if kind == "sources":
                self.sources = content
            elif kind != "done":
                out.append((kind, content))
        return out + self.close("timeout")


#: State of a bucket: an array for each field of its requests; an early event has the number of its request.
BUCKET = """request array<string>, wake array<long>, next array<long>, place array<long>, closed array<boolean>, sources array<string>,
  owner array<long>, seq array<long>, type array<string>, content array<string>"""
#: What leaves of a request, in rows of at most ``TOGETHER`` events.
LEFT, TOGETHER = "request string, place long, types array<string>, contents array<string>", 4096


def _load(kept: tuple | None) -> dict[str | None, Request]:
    if kept is None:
        return {}
    names, *fields, owner, seq, kind, content = kept
    known = [Request(*r) for r in zip(*fields, strict=True)]
    for i, s, k, c in zip(owner, seq, kind, content, strict=True):
        known[i].waiting[s] = (k, c)
    return dict(zip(names, known, strict=True))


def _kept(requests: dict[str | None, Request]) -> tuple:
    known = list(requests.values())
    early = [(i, s, *e) for i, r in enumerate(known) for s, e in r.waiting.items()]
    columns = [list(c) for c in zip(*early, strict=True)] or [[], [], [], []]
    return (list(requests), [r.wake for r in known], [r.next for r in known], [r.place for r in known], [r.closed for r in known], [r.sources for r in known], *columns)


def token_order(silence_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The events of the requests of a bucket, each in the order of ``seq`` and closed exactly once."""

    def turn(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, touched, out = _load(state.getOption), set(), []

        def leave(name: str | None, r: Request, events: list[tuple]) -> None:
            for i in range(0, len(events), TOGETHER):
                types, contents = zip(*events[i : i + TOGETHER], strict=True)
                out.append((name, r.place + i, list(types), list(contents)))
            r.place += len(events)

        for part in () if state.hasTimedOut else parts:
            for name, seq, kind, content, at in zip(*(part[c].tolist() for c in ("request", "seq", "type", "content", "at")), strict=True):
                r = requests.get(name)
                if r is None:
                    r = requests[name] = Request(silence_ms)
                touched.add(name)
                if at + silence_ms > r.wake:
                    r.wake = at + silence_ms
                if not r.closed and seq >= r.next:
                    r.waiting.setdefault(int(seq), (kind, content))
        for name in touched:
            leave(name, requests[name], requests[name].ready())
        upto, first = state.getCurrentWatermarkMs(), None
        for name, r in list(requests.items()):
            if r.wake <= upto and not r.closed:
                leave(name, r, r.rest())
                # stragglers of the next spell find the request closed
                r.wake += silence_ms
            if r.wake <= upto:
                del requests[name]
            elif first is None or r.wake < first:
                first = r.wake
        if requests:
            state.update(_kept(requests))
            # a time is over when the watermark is beyond it
            state.setTimeoutTimestamp(max(first - 1, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request", "place", "types", "contents"])

    return turn


def ordered_tokens(events: DataFrame, silence: int = 60, late: str = "60 seconds", buckets: int = 256) -> DataFrame:
    """(request, place, type, content) of a stream of events (request, seq, type, content, ts).

    Events may arrive in any order and more than once; they leave in the order
    of ``seq`` (from 0) as soon as all before them have.  The last ``sources``
    leaves just before ``done``, which ends a request; what comes after is
    dropped.  A request without events for ``silence`` seconds of event time
    is closed: what it held leaves without the missing events, then its
    sources and a ``done`` whose content is "timeout".  Events more than
    ``late`` behind the newest are dropped.  A closed request is remembered
    for another ``silence`` seconds.

    Requests share state and a timer in ``buckets``, since each call for a key
    takes as long as hundreds of rows.  Their number must stay the same for a
    stream that goes on; what is open in a bucket must fit a task.
    """
    at = F.col("ts").cast("timestamp")
    bucket = F.pmod(F.xxhash64("request"), F.lit(buckets)).alias("bucket")
    rows = events.select(bucket, "request", "seq", "type", "content", F.coalesce(F.unix_millis(at), F.lit(0)).alias("at"), at.alias("ts")).withWatermark("ts", late)
    left = rows.groupBy("bucket").applyInPandasWithState(token_order(silence * 1000), LEFT, BUCKET, "append", GroupStateTimeout.EventTimeTimeout)
    each = left.select("request", "place", F.posexplode(F.arrays_zip("types", "contents")).alias("i", "event"))
    return each.select("request", (F.col("place") + F.col("i")).alias("place"), F.col("event.types").alias("type"), F.col("event.contents").alias("content"))


class CacheLookups(StatefulProcessor):
    """Requests of one cache in the order of their time; an entry lives ``ttl`` and the oldest goes when all places are taken."""

    def __init__(self, ttl_us: int | None, most: int):
        self.ttl_us, self.most = ttl_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long, query string")
        self.cache = handle.getListState("cache", "query string, expires long")
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(a), int(s), q) for part in rows for a, s, q in zip(part["at"], part["seq"], part["query"], strict=True)]
        self.held.appendList(new)
        low, first = min(new)[0], self.first.get()
        # what is held is read only when some of it is ready
        if first is None or low < first[0]:
            for timer in list(self.handle.listTimers()) if first is not None else ():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(low // 1000)
            self.first.update((low,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get())
        ready, rest = [r for r in held if r[0] // 1000 <= upto], [r for r in held if r[0] // 1000 > upto]
        # in the order of entry, which is that of expiry too
        entries = {q: e for q, e in self.cache.get()} if self.cache.exists() else {}
        out = []
        for at, seq, query in ready:
            hit = query in entries and (self.ttl_us is None or at < entries[query])
            if not hit:
                entries.pop(query, None)
                if len(entries) >= self.most:
                    del entries[next(iter(entries))]
                entries[query] = 0 if self.ttl_us is None else at + self.ttl_us
            out.append((key[0], seq, query, hit))
        self.cache.put(list(entries.items()))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
            self.first.update((rest[0][0],))
        else:
            self.held.clear()
            self.first.clear()
        yield pd.DataFrame(out, columns=["shard", "seq", "query", "hit"])


def cache_lookups(requests: DataFrame, ttl: int | None = 300, most: int = 512, late: str = "10 seconds") -> DataFrame:
    """(shard, seq, query, hit) of a stream of requests (shard, seq, query, ts).

    Every shard is a cache of its own, such as a server's.  Queries are the
    same but for case and blanks.  A request hits if its query was entered
    less than ``ttl`` seconds before (or ever, for None) and is still there;
    otherwise it is entered, for which the first to expire of ``most`` entries
    goes.  Requests are taken in the order of (ts, seq) once nothing can come
    before them, ``late`` behind the newest; later ones are dropped.  State
    is ``most`` entries and the requests of the last ``late`` for each shard.
    """
    at = F.col("ts").cast("timestamp")
    rows = requests.select("shard", "seq", F.lower(squash(F.col("query"))).alias("query"), at.alias("ts"), F.unix_micros(at).alias("at")).withWatermark("ts", late)
    kind = requests.schema["shard"].dataType.simpleString()
    return rows.groupBy("shard").transformWithStateInPandas(CacheLookups(None if ttl is None else ttl * 1_000_000, most), f"shard {kind}, seq long, query string, hit boolean", "append", "eventtime")
