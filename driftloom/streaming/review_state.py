"""Review marks that survive from head to head, as keyed state over a stream of analyses and marks.

Events: identity, kind ('record' or 'mark'), head, prints (array of fingerprint, path; of a record), add and remove (arrays of
fingerprints; of a mark), seq. For each record the delta against the last distinct head comes out. A working tree counts as another
head only when its set of fingerprints differs. The state is one JSON text for each identity; reviews are small, and identities are spread over the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELTA = "identity string, seq long, prev_head string, new array<string>, changed array<string>, marks array<string>"
STATE = "entry string"


def apply(entry: dict, event: dict) -> dict | None:
    """Changes an entry by one event; the delta of a record, None of a mark."""
    marks = entry.setdefault("marks", [])
    if event["kind"] == "mark":
        gone = set(event["remove"])
        kept = [m for m in marks if m not in gone]
        entry["marks"] = kept + [m for m in dict.fromkeys(event["add"]) if m not in kept]
        return None
    head, seen = event["head"] or "worktree", {p["fingerprint"]: p["path"] for p in event["prints"]}
    before = entry.get("head")
    if before is not None and (before != head or head == "worktree" and set(entry["seen"]) != set(seen)):
        entry["previous"] = {"head": before, "seen": entry["seen"], "marks": list(marks)}
    entry |= {"head": head, "seen": seen, "marks": [m for m in marks if m in seen]}
    old = entry.get("previous")
    return {
        "seq": event["seq"], "prev_head": old["head"] if old else None, "marks": entry["marks"],
        "new": [f for f in seen if f not in old["seen"]] if old else [], "changed": [m for m in old["marks"] if m not in seen] if old else [],
    }


def _events(frame: pd.DataFrame) -> list[dict]:
    rows = frame.sort_values("seq").to_dict("records")
    full = lambda x: [] if x is None else list(x)
    return [r | {"add": full(r["add"]), "remove": full(r["remove"]), "prints": [p if isinstance(p, dict) else p.asDict() for p in full(r["prints"])]} for r in rows]


def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entry = json.loads(state.get[0]) if state.exists else {}
    events = sorted((e for frame in frames for e in _events(frame)), key=lambda e: e["seq"])  # a key may come in several frames
    out = [{"identity": key[0], **d} for e in events if (d := apply(entry, e))]
    state.update((json.dumps(entry),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in DELTA.split(", ")])


def deltas(events: DataFrame) -> DataFrame:
    """The streaming form."""
    return events.groupBy("identity").applyInPandasWithState(step, DELTA, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame) -> DataFrame:
    """The batch form: the same events from the beginning."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        entry: dict = {}
        return pd.DataFrame([{"identity": key[0], **d} for e in _events(frame) if (d := apply(entry, e))], columns=[c.split()[0] for c in DELTA.split(", ")])

    return events.groupBy("identity").applyInPandas(run, DELTA)
