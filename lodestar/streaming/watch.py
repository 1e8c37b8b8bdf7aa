"""The watch loop as a stateful stream: debounced groups of changes become rebuild plans, one build at a time.

Events have session, seq, path, old_path, kind and ts; kind is create, modify, delete, rename, overflow, error, or `built`
when a build has ended. Each session's state holds what is pending by path, the timer of its debounce, and the plan that
waits for the running build. A group ends when no event came for the debounce time: by a timer once the watermark has
passed it, or by the next event where both are in one batch. Times are event times, so a replay gives the same plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.streaming.events import DEBOUNCE_MS, KINDS, MAX_PENDING, RESCAN, merge_kinds, snapshot_diff

PLAN = "session string, mode string, reason string, paths array<string>, first_seq long, last_seq long, at timestamp"
STATE = "seen long, deadline long, rescan string, building boolean, queued array<string>, queued_mode string, queued_reason string, queued_first long, queued_last long"
PENDING = "path string, old_path string, kind string, first_seq long, last_seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch:
    """One session: what is pending, what is being built, what waits. All of it is plain values."""

    def __init__(self, debounce_ms: int = DEBOUNCE_MS, most: int = MAX_PENDING, gaps: bool = True) -> None:
        self.debounce, self.most, self.gaps = debounce_ms, most, gaps
        self.pending: dict[str, tuple] = {}  # path, old path, kind, first and last sequence number
        self.seen: int | None = None
        self.deadline: int | None = None
        self.rescan: str | None = None
        self.building = False
        self.queued: tuple | None = None  # mode, reason, paths, first and last sequence number

    def rescans(self, reason: str) -> None:
        self.rescan = self.rescan or reason

    def add(self, at: int, seq: int | None, path: str | None, old: str | None, kind: str) -> list[tuple]:
        """Takes an event of the time `at` (ms); the plans that are due, as (mode, reason, paths, first, last, time)."""
        out = self.due(at)
        if kind == "built":
            self.building = False
            if self.queued:
                out.append((*self.queued, at))
                self.building, self.queued = True, None
            return out
        self.deadline = at + self.debounce
        if seq is not None and seq > 0:
            if self.gaps and self.seen is not None and seq > self.seen + 1:
                self.rescans("watch_sequence_gap")
            self.seen = max(seq, self.seen or 0)
        if kind in RESCAN:
            self.rescans(kind)
            return out
        if kind not in KINDS:
            self.rescans("error")
            return out
        if kind == "rename" and not (path and old):
            self.rescans("ambiguous_rename")
        key = f"{old}\x00{path}" if old else path or f"{kind}\x00{seq}"
        before = self.pending.get(key)
        if before is None and len(self.pending) >= self.most:
            self.pending = {}
            self.rescan = "pending_event_limit_exceeded"
            return out
        now = merge_kinds(before[2] if before else None, kind)
        if now is None:
            del self.pending[key]
        else:
            ends = [s for s in (seq, *(before[3:] if before else ())) if s is not None]
            self.pending[key] = (path, old or (before[1] if before else None), now, min(ends, default=None), max(ends, default=None))
        return out

    def due(self, now: int) -> list[tuple]:
        """Ends the group whose debounce time is over by `now`: its plan, unless a build is running; then the plan waits, and
        a second one that waits makes it a full rescan of the paths of both."""
        if self.deadline is None or now < self.deadline:
            return []
        at, self.deadline = self.deadline, None
        if not self.pending and not self.rescan:
            return []
        paths = {p for e in self.pending.values() for p in e[:2] if p}
        seqs = [s for e in self.pending.values() for s in e[3:] if s is not None]
        plan = ("full_rescan" if self.rescan else "selective", self.rescan or "", sorted(paths), min(seqs, default=None), max(seqs, default=None))
        self.pending, self.rescan = {}, None
        if not self.building:
            self.building = True
            return [(*plan, at)]
        if self.queued:
            ends = [s for s in (*self.queued[3:], *plan[3:]) if s is not None]
            plan = ("full_rescan", "changes_arrived_during_build", sorted({*self.queued[2], *plan[2]}), min(ends, default=None), max(ends, default=None))
        self.queued = plan
        return []


class WatchProcessor(StatefulProcessor):
    def __init__(self, debounce_ms: int, most: int, gaps: bool) -> None:
        self.made = (debounce_ms, most, gaps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.pending = handle.getMapState("pending", "key string", PENDING)

    def load(self) -> Watch:
        own = Watch(*self.made)
        if self.state.exists():
            own.seen, own.deadline, own.rescan, own.building, paths, mode, reason, first, last = self.state.get()
            own.queued = (mode, reason, list(paths), first, last) if mode else None
        own.pending = {k[0]: tuple(v) for k, v in self.pending.iterator()}
        return own

    def store(self, own: Watch, before: dict[str, tuple], timer: int | None) -> None:
        """What changed of the session; its timer follows the deadline."""
        for key in before.keys() - own.pending.keys():
            self.pending.removeKey((key,))
        for key, value in own.pending.items():
            if before.get(key) != value:
                self.pending.updateValue((key,), value)
        mode, reason, paths, first, last = own.queued or (None, None, None, None, None)
        self.state.update((own.seen, own.deadline, own.rescan, own.building, paths, mode, reason, first, last))
        if timer != own.deadline:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if own.deadline is not None:
                self.handle.registerTimer(own.deadline)

    def plans(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            rows = [(key[0], *p[:5], pd.Timestamp(p[5], unit="ms", tz="UTC")) for p in found]
            yield pd.DataFrame(rows, columns=["session", "mode", "reason", "paths", "first_seq", "last_seq", "at"]).astype({"first_seq": "Int64", "last_seq": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = self.load()
        before, timer, found = dict(own.pending), own.deadline, []
        for pdf in rows:  # in order within each part of a batch
            pdf = pdf.sort_values(["ms", "seq"], kind="stable")
            for at, seq, path, old, kind in zip(pdf["ms"].tolist(), pdf["seq"].tolist(), pdf["path"].tolist(), pdf["old_path"].tolist(), pdf["kind"].tolist(), strict=True):
                found += own.add(int(at), None if pd.isna(seq) else int(seq), path, old, kind or "error")
        self.store(own, before, timer)
        yield from self.plans(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self.load()
        before, timer = dict(own.pending), own.deadline
        found = own.due(expiredTimerInfo.getExpiryTimeInMs())
        self.store(own, before, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield from self.plans(key, found)

    def close(self) -> None:
        pass


def rebuild_plans(events: DataFrame, lateness: str = "1 second", debounce_ms: int = DEBOUNCE_MS, most: int = MAX_PENDING, gaps: bool = True) -> DataFrame:
    """The rebuild plans of a stream of events, as they fall due: session, mode (selective, full_rescan), reason, paths, first_seq,
    last_seq, at. Events later than the watermark are dropped by Spark; a session without an event has no plan."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # what keeps timers
    own = events.select("session", "seq", "path", "old_path", "kind", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", lateness)
    return own.groupBy("session").transformWithStateInPandas(WatchProcessor(debounce_ms, most, gaps), PLAN, "Append", "EventTime")


def drained(plans: DataFrame, folder: str) -> DataFrame:
    """All that a stream of plans gives for what its source holds now, as a table in `folder`."""
    spark: SparkSession = plans.sparkSession
    query = plans.writeStream.format("parquet").option("path", f"{folder}/plans").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(PLAN).parquet(f"{folder}/plans")


def reconciliation(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(mode, reason, paths): a full rescan where fingerprints (path, size, hash) differ from those of the last build, else no row.

    This is what a timer runs beside the stream, for changes that no event told of.
    """
    changed = snapshot_diff(previous, current).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return changed.filter(F.size("paths") > 0).select(F.lit("full_rescan").alias("mode"), F.lit("periodic_reconciliation_changed").alias("reason"), "paths")
