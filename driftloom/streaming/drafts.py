"""Drafts of reviews as keyed state: comments in a map, waiting events in a list, timers that apply and expire them.

Events: draft (the key), seq (unique in a draft), ts, kind ('add', 'edit', 'discard', 'clear'), id (of edit and discard), path, line, body, head.
An add gets the id d<n>, n one more than the draft's last; a draft that has become empty goes, and a new one counts from d1 with the head of its first
comment. Changes of comments that aren't there do nothing.

Events wait in the list until the watermark has passed them, and a timer at their time applies them in the order of (ts, seq), however they came in. So
the outcome is that of a replay in order. An event that comes after the watermark has passed its time is late and changes nothing; one that
repeats a waiting or applied seq neither. A draft without an event for `idle` goes by a timer too.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

EVENT = "seq long, at long, kind string, id string, path string, line int, body string, head string"
COMMENT = "n long, path string, line int, body string, created long"
CHANGE = "draft string, seq long, kind string, id string, path string, line int, body string, head string, comments long"
FIELDS = [c.split()[0] for c in EVENT.split(", ")]
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
IDLE = 30 * 86_400_000


def apply(comments: dict[str, tuple], meta: dict, event: tuple) -> tuple | None:
    """Changes a draft (comments by id; meta: next, head) by one event; what came of it as kind, id, path, line, body, or None."""
    _, at, kind, id_, path, line, body, head = event
    if kind == "add":
        if not comments:
            meta |= {"next": 0, "head": head}
        meta["next"] += 1
        id_ = f"d{meta['next']}"
        comments[id_] = (meta["next"], path, line, body, at)
    elif kind == "edit" and id_ in comments:
        n, path, line, _, created = comments[id_]
        comments[id_] = (n, path, line, body, created)
    elif kind == "discard" and id_ in comments:
        _, path, line, body, _ = comments.pop(id_)
    elif kind in ("clear", "expired") and comments:
        comments.clear()
        id_, path, line, body = None, None, None, None
    else:
        return None
    return kind, id_, path, line, body


def millis(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts, utc=True) - pd.Timestamp(0, tz="UTC")).dt.total_seconds().mul(1000).round().astype("int64").tolist()


def clean(value: object) -> object:
    return None if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value else value.item() if hasattr(value, "item") else value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Events as tuples in EVENT's order."""
    frame = frame.assign(at=millis(frame["ts"]), line=frame["line"].astype("Int64").astype(object))
    return [tuple(clean(v) for v in r) for r in frame[FIELDS].itertuples(index=False, name=None)]


class Drafts(StatefulProcessor):
    def __init__(self, idle: int = IDLE):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.comments = handle.getMapState("comments", "id string", COMMENT)
        self.meta = handle.getValueState("meta", "next long, head string, last long, timer long")
        self.waiting = handle.getListState("waiting", EVENT)
        self.applied = handle.getMapState("applied", "seq long", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        seen, fresh = {e[0] for e in self.waiting.get()}, []
        for event in (e for frame in rows for e in rows_of(frame)):
            if event[1] > mark and event[0] not in seen and not self.applied.containsKey((event[0],)):
                seen.add(event[0])
                fresh.append(event)
        if fresh:
            self.waiting.appendList(fresh)
            for at in {e[1] for e in fresh}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: (e[1], e[0]))
        due, rest = [e for e in events if e[1] <= now], [e for e in events if e[1] > now]
        meta = dict(zip(("next", "head", "last", "timer"), self.meta.get(), strict=True)) if self.meta.exists() else {"next": 0, "head": None, "last": now, "timer": None}
        if not due and meta["last"] + self.idle > now:
            return
        comments, out = {k[0]: tuple(v) for k, v in self.comments.iterator()}, []
        before = dict(comments)
        if not due:
            due = [(-1, now, "expired", None, None, None, None, None)]
        for event in due:
            got = apply(comments, meta, event)
            if got:
                out.append((key[0], event[0], *got, meta["head"], len(comments)))
            if event[0] >= 0:
                self.applied.updateValue((event[0],), (event[1],))
                meta["last"] = event[1]
        for k in before.keys() - comments.keys():
            self.comments.removeKey((k,))
        for k, v in comments.items():
            if before.get(k) != v:
                self.comments.updateValue((k,), v)
        self.waiting.put(rest) if rest else self.waiting.clear()
        if due[0][0] >= 0:
            # the idle timer moves with the last event; of the seqs only those young enough to come again are kept
            if meta["timer"] is not None:
                self.handle.deleteTimer(meta["timer"])
            meta["timer"] = meta["last"] + self.idle
            self.handle.registerTimer(meta["timer"])
        else:
            self.applied.clear()
        self.meta.update((meta["next"], meta["head"], meta["last"], meta["timer"] if due[0][0] >= 0 else None))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def draft_changes(events: DataFrame, delay: str = "10 minutes", idle: timedelta = timedelta(milliseconds=IDLE)) -> DataFrame:
    """The streaming form: CHANGE for each event that changed its draft, and for drafts that were idle for too long. Needs
    the RocksDB state store."""
    keyed = events.withWatermark("ts", delay).groupBy("draft")
    return keyed.transformWithStateInPandas(Drafts(int(idle.total_seconds() * 1000)), CHANGE, "append", "eventTime")


def replayed(events: DataFrame, idle: timedelta = timedelta(milliseconds=IDLE)) -> DataFrame:
    """The batch form: the same changes of events in the order of (ts, seq); the last idle time of a draft isn't waited for."""
    wait = int(idle.total_seconds() * 1000)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        comments, meta, out, last = {}, {"next": 0, "head": None}, [], None
        once = {e[0]: e for e in sorted(rows_of(frame), key=lambda e: e[1], reverse=True)}
        for event in sorted(once.values(), key=lambda e: (e[1], e[0])):
            if last is not None and event[1] > last + wait and (got := apply(comments, meta, (-1, last + wait, "expired", *[None] * 5))):
                out.append((key[0], -1, *got, meta["head"], len(comments)))
            last = event[1]
            if got := apply(comments, meta, event):
                out.append((key[0], event[0], *got, meta["head"], len(comments)))
        return pd.DataFrame(out, columns=COLUMNS)

    return events.groupBy("draft").applyInPandas(run, CHANGE)
