"""State by key whose next step depends on all steps before it: requests that a host's budget admits, and a cache with expiry.

Each is a StatefulProcessor for streams, with timers that forget what no later row can tell from nothing, and a batch twin
that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


@dataclass(frozen=True)
class Budget:
    """So many requests of a host in a window, of which a share is set aside for sources of low yield."""

    ceiling: int
    window_s: int
    reserve: float = 0.10

    def most(self, low_yield: bool) -> int:
        return self.ceiling if low_yield else int(self.ceiling * (1 - self.reserve))

    def step(self, state: tuple[int, int, int] | None, at: int, low_yield: bool, retry_after_s: float | None) -> tuple[tuple[int, int, int], str]:
        """(state, decision) of the next request; state: (window's start, requests taken in it, end of the cooldown), in microseconds.

        A window opens with the first request after the one before it has run out. Only requests that are taken count, and
        only their answers can ask for a cooldown, which a new window does not end.
        """
        begun, used, until = state or (at, 0, 0)
        if at - begun >= self.window_s * MICROS:
            begun, used = at, 0
        if at < until:
            return (begun, used, until), "COOLDOWN"
        if used >= self.most(low_yield):
            return (begun, used, until), "BUDGET"
        if retry_after_s is not None and retry_after_s == retry_after_s:
            until = at + int(retry_after_s * MICROS)
        return (begun, used + 1, until), "TAKEN"


DECISIONS = "host string, request long, decision string, used long"


def _fold(budget: Budget, state: tuple[int, int, int] | None, rows: pd.DataFrame) -> tuple[tuple[int, int, int] | None, list[tuple[str, int]]]:
    out = []
    for at, low, retry in zip(rows["at_us"].tolist(), rows["low_yield"].tolist(), rows["retry_after_s"].tolist(), strict=True):
        state, decision = budget.step(state, at, bool(low), retry)
        out.append((decision, state[1]))
    return state, out


def _decided(host: str, rows: pd.DataFrame, out: list[tuple[str, int]]) -> pd.DataFrame:
    return pd.DataFrame({"host": host, "request": rows["request"].to_numpy(), "decision": [d for d, _ in out], "used": [u for _, u in out]})


def _requests(df: DataFrame) -> DataFrame:
    """(host, request, at_us, low_yield, retry_after_s): the columns that are read, a null yield is not low."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    return df.select(F.col("host").cast("string").alias("host"), F.col("request").cast("long").alias("request"), "at", at.alias("at_us"), F.coalesce("low_yield", F.lit(False)).alias("low_yield"), F.col("retry_after_s").cast("double").alias("retry_after_s"))


def admitted(requests: DataFrame, budget: Budget) -> DataFrame:
    """(host, request, decision, used) of requests (host, request, at, low_yield, retry_after_s), in the order of (at, request).

    A host's requests are cut where its state begins anew whatever was taken: after a pause of a window, when no cooldown
    that any request asked for lasts. The stretches are dealt to tasks, and each is read in order and never held whole.
    """
    rows = _requests(requests).where("at_us is not null").drop("at")
    order = Window.partitionBy("host").orderBy("at_us", "request")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = F.col("at_us") + F.coalesce(F.col("retry_after_s") * MICROS, F.lit(0.0))
    new = (F.col("at_us") - F.lag("at_us").over(order) >= budget.window_s * MICROS) & (F.col("at_us") > F.max(until).over(before))
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("stretch", F.sum("_new").over(order)).drop("_new")
    dealt = rows.repartition("host", "stretch").sortWithinPartitions("host", "stretch", "at_us", "request")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            # equal neighbours of (host, stretch) are one stretch, which may go on from the batch before
            mark = list(zip(batch["host"].tolist(), batch["stretch"].tolist(), strict=True))
            edges = [0, *(k for k in range(1, len(mark)) if mark[k] != mark[k - 1]), len(mark)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if mark[a] != key:
                    key, state = mark[a], None
                part = batch.iloc[a:b]
                state, out = _fold(budget, state, part)
                yield _decided(key[0], part, out)

    return dealt.mapInPandas(fold, DECISIONS)


class Admission(StatefulProcessor):
    """Admits a stream's requests; a host that has been silent for a window, with no cooldown left, is forgotten."""

    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "begun long, used long, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "request"], kind="stable")
        state, out = _fold(self.budget, self.state.get() if self.state.exists() else None, batch)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = int(batch["at_us"].iloc[-1])
        self.handle.registerTimer(max(last + self.budget.window_s * MICROS, state[2]) // 1000 + 1)
        yield _decided(key[0], batch, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, budget: Budget, late: str = "0 seconds") -> DataFrame:
    """admitted() over a stream. Within a micro-batch a host's requests are taken in order; across batches, as they come. Needs the RocksDB state store."""
    rows = _requests(requests).withWatermark("at", late)
    return rows.groupBy("host").transformWithStateInPandas(Admission(budget), DECISIONS, "Append", "EventTime")


READS = "url_hash string, seq long, hit boolean, content string"


def url_hash(url: F.Column) -> F.Column:
    return F.sha2(url.cast("binary"), 256)


def _operations(df: DataFrame) -> DataFrame:
    """(url_hash, seq, at, at_us, op, content); rows without an address or a time are left out."""
    rows = df.where("url is not null and at is not null")
    return rows.select(url_hash(F.col("url")).alias("url_hash"), F.col("seq").cast("long").alias("seq"), "at", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "op", "content")


def cache_reads(operations: DataFrame, ttl_s: int) -> DataFrame:
    """(url_hash, seq, hit, content) of each read of a cache, by operations (url, seq, at, op 'put' or 'get', content).

    Operations come in the order of seq; at is when each was made. Of the writes that came before a read, the one made
    last is found, and it holds for ttl_s seconds from then; a write that comes late does not replace a later one.
    """
    rows = _operations(operations)
    before = Window.partitionBy("url_hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("op") == "put", F.struct("at_us", "seq", "content"))).over(before)
    found = rows.withColumn("_last", last).where(F.col("op") == "get")
    hit = F.coalesce(F.col("at_us") < F.col("_last.at_us") + ttl_s * MICROS, F.lit(False))
    return found.select("url_hash", "seq", hit.alias("hit"), F.when(hit, F.col("_last.content")).alias("content"))


class Cache(StatefulProcessor):
    """A cache by address; what no later read can hit is forgotten by a timer."""

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", "at_us long, seq long, content string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        entry = self.state.get() if self.state.exists() else None
        batch, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for seq, at, op, content in zip(batch["seq"].tolist(), batch["at_us"].tolist(), batch["op"].tolist(), batch["content"].tolist(), strict=True):
            if op == "put":
                new = (at, seq, content)
                entry = new if entry is None or new[:2] > tuple(entry)[:2] else entry
            elif op == "get":
                hit = entry is not None and at < entry[0] + self.ttl
                out.append((key[0], seq, hit, entry[2] if hit else None))
        if entry is not None:
            self.state.update(tuple(entry))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((entry[0] + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["url_hash", "seq", "hit", "content"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def read_stream(operations: DataFrame, ttl_s: int, late: str) -> DataFrame:
    """cache_reads() over a stream, for operations that are made no more than `late` before the latest one seen."""
    rows = _operations(operations).withWatermark("at", late)
    return rows.groupBy("url_hash").transformWithStateInPandas(Cache(ttl_s), READS, "Append", "EventTime")
