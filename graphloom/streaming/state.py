"""Custom per-session state: context reuse with a bounded memory, and the raw text budget.

State lives in RocksDB, one small entry per session, list item and map key. A session that the watermark has left behind
for an hour is removed by its event-time timer, so what is kept follows the sessions of the last hours, not all there
ever were. How many rows a micro-batch brings is set at the source (files per batch); inside a micro-batch a session's
rows are put in order before they are judged.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Session limits.
MAX_REFS, MAX_SPANS, TTL_SECONDS = 200, 256, 3600
CHUNK = 10_000  # rows handed on at a time
RAW_BUDGETS = {"tight": 1500, "balanced": 4000, "wide": 12000}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class RefMemory:
    """References already sent, oldest forgotten first; a new revision starts over."""

    def __init__(self, revision: int = -1, order: Iterable[str] = (), cap: int = MAX_REFS):
        self.revision, self.cap = revision, cap
        self.order = deque(order)
        self.known = set(self.order)

    def accept(self, ref: str, revision: int) -> bool:
        """True when the reference is new to the session."""
        if revision != self.revision:
            self.revision, self.order, self.known = revision, deque(), set()
        if ref in self.known:
            return False
        self.order.append(ref)
        self.known.add(ref)
        while len(self.order) > self.cap:
            self.known.discard(self.order.popleft())
        return True


class RawBudget:
    """Raw text already shown in a session; a span that does not fit is skipped, a new revision starts over."""

    def __init__(self, revision: int = -1, used: int = 0, order: Iterable[str] = (), budget: int = RAW_BUDGETS["balanced"], cap: int = MAX_SPANS):
        self.revision, self.used, self.budget, self.cap = revision, used, budget, cap
        self.order = deque(order)
        self.known = set(self.order)

    def request(self, span: str, chars: int, revision: int = -1) -> str:
        if revision != self.revision:
            self.revision, self.used, self.order, self.known = revision, 0, deque(), set()
        if span in self.known:
            return "already_in_context"
        if self.used + chars > self.budget:
            return "budget_exhausted"
        self.used += chars
        self.order.append(span)
        self.known.add(span)
        while len(self.order) > self.cap:
            self.known.discard(self.order.popleft())
        return "kept"


def in_order(chunks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A session's rows of one micro-batch in order of position, whatever chunks they came in."""
    rows = pd.concat(list(chunks), ignore_index=True).sort_values("pos", kind="stable")
    for at in range(0, len(rows), CHUNK):
        yield rows.iloc[at:at + CHUNK]


class SessionProcessor(StatefulProcessor):
    """What all session states share: the time of the last row, expiry by it, and the timer that removes a silent session."""

    def __init__(self, ttl_ms: int = TTL_SECONDS * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")
        self.open(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        memory = self.load() if last is not None else self.fresh()
        for chunk in in_order(rows):
            marks = []
            for row in chunk.itertuples(index=False):
                if last is not None and row.ts_ms - last > self.ttl_ms:
                    memory = self.fresh()
                last = int(row.ts_ms)
                marks.append(self.judge(memory, row))
            yield self.answer(chunk, marks)
        self.save(memory)
        self.last.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.ttl_ms + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class SentRefs(SessionProcessor):
    """Marks each reference of a session as fresh or already sent. The memory is a list, oldest first."""

    OUT = "session_id bigint, pos bigint, ref string, fresh boolean"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "n long")
        self.refs = handle.getListState("refs", "ref string")

    def fresh(self) -> RefMemory:
        return RefMemory()

    def load(self) -> RefMemory:
        return RefMemory(self.revision.get()[0], [r[0] for r in self.refs.get()])

    def save(self, memory: RefMemory) -> None:
        self.revision.update((memory.revision,))
        self.refs.put([(r,) for r in memory.order])

    def clear(self) -> None:
        self.revision.clear()
        self.refs.clear()

    def judge(self, memory: RefMemory, row: Any) -> bool:
        return memory.accept(row.ref, int(row.revision))

    def answer(self, chunk: pd.DataFrame, marks: list[bool]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": chunk["session_id"], "pos": chunk["pos"], "ref": chunk["ref"], "fresh": marks})


class ShownSpans(SessionProcessor):
    """Raw text budget of a session. The memory is a map from span to its place; only changes are written."""

    OUT = "session_id bigint, pos bigint, span string, outcome string"

    def __init__(self, budget: int, ttl_ms: int = TTL_SECONDS * 1000):
        super().__init__(ttl_ms)
        self.budget = budget

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "revision long, used long, next long")
        self.spans = handle.getMapState("spans", "span string", "place long")

    def fresh(self) -> RawBudget:
        return RawBudget(budget=self.budget)

    def load(self) -> RawBudget:
        revision, used, self.next = self.session.get()
        self.stored = {k[0]: v[0] for k, v in self.spans.iterator()}
        return RawBudget(revision, used, sorted(self.stored, key=self.stored.get), self.budget)

    def save(self, memory: RawBudget) -> None:
        stored, place = (self.stored, self.next) if self.session.exists() else ({}, 0)
        # A span forgotten and shown again moves to the end: places must rise along the order.
        last = -1
        for span in memory.order:
            if stored.get(span, -1) <= last:
                stored[span] = place
                self.spans.updateValue((span,), (place,))
                place += 1
            last = stored[span]
        for span in stored.keys() - memory.known:
            self.spans.removeKey((span,))
        self.session.update((memory.revision, memory.used, place))

    def clear(self) -> None:
        self.session.clear()
        self.spans.clear()

    def judge(self, memory: RawBudget, row: Any) -> str:
        return memory.request(row.span, int(row.chars), int(row.revision))

    def answer(self, chunk: pd.DataFrame, marks: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": chunk["session_id"], "pos": chunk["pos"], "span": chunk["span"], "outcome": marks})


def _sessions(stream: DataFrame, processor: SessionProcessor, delay: str) -> DataFrame:
    timed = stream.selectExpr("*", "timestamp_millis(ts_ms) AS event_time").withWatermark("event_time", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(processor, processor.OUT, "append", "eventTime")


def reuse_context(stream: DataFrame, delay: str = "1 hour", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Streaming context reuse over (session_id, pos, ts_ms, ref, revision)."""
    return _sessions(stream, SentRefs(ttl_seconds * 1000), delay)


def limit_raw_text(stream: DataFrame, budget: int = RAW_BUDGETS["balanced"], delay: str = "1 hour", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Streaming raw text budget over (session_id, pos, ts_ms, span, chars, revision)."""
    return _sessions(stream, ShownSpans(budget, ttl_seconds * 1000), delay)


def on_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state is in RocksDB; other queries of the session keep their own provider."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
