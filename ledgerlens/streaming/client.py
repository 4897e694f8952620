"""The client's fold of job events over a stream, with state by job.

A job's events are applied in the order of seq. What comes early waits in the state until what is missing
comes; what comes again is dropped. A job that nothing was heard of for a while is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.client import BECOMES, EVENT, STATE
from ledgerlens.operators.jobs import RUNNABLE, STOPPED

DOC = "status string, done int, total int, outcomes array<string>, error string"
FIELDS = [f.split()[0] for f in EVENT.split(", ")][1:]


def after(doc: tuple | None, e: dict[str, Any]) -> tuple:
    """A document's (status, done, total, outcomes, error) after an event of its own."""
    status, done, total, outcomes, error = doc or (None, 0, 0, [], None)
    kind = e["event"]
    if kind == "snapshot":
        return e["status"], e["done"] or 0, e["total"] or 0, list(e["outcomes"] or []), e["error"]
    if kind == "doc_started":
        return "running", 0, 0, [], None
    if kind == "page_done":
        outcomes = [*outcomes, *(e["outcomes"] or [])]
    if kind in ("page_done", "stream"):
        done, total, error = e["done"] or 0, e["total"] or 0, None
    if kind == "doc_done":
        done, total, error = len(outcomes), len(outcomes), None
    if kind == "doc_error":
        error = e["error"]
    return BECOMES.get(kind, status), done, total, outcomes, error


class ClientFold(StatefulProcessor):
    """patience: for how long a gap is waited for before what follows it is applied; keep: for how long a silent job's state stays."""

    def __init__(self, patience_ms: int, keep_ms: int):
        self.patience, self.keep = patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.docs = handle.getMapState("docs", "doc long", DOC, self.keep)
        self.seen = handle.getValueState("seen", "seq long", self.keep)
        self.early = handle.getListState("early", EVENT.split(", ", 1)[1], self.keep)

    def _apply(self, job: int, events: list[dict[str, Any]], gaps: bool) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        ready = sorted({e["seq"]: e for e in events if e["seq"] > seen}.items())
        changed: dict[int, tuple] = {}
        while ready and (gaps or ready[0][0] <= seen + 1):
            seen, e = ready.pop(0)
            if e["doc"] is not None:
                doc = changed.get(e["doc"]) or (self.docs.getValue((e["doc"],)) if self.docs.containsKey((e["doc"],)) else None)
                changed[e["doc"]] = after(doc, e)
            elif e["event"] == "job_status" and e["status"] == "cancelled":
                have = {k[0]: tuple(v) for k, v in self.docs.iterator()} | changed
                changed |= {k: ("cancelled", *v[1:4], STOPPED) for k, v in have.items() if v[0] in RUNNABLE}
        for doc, state in changed.items():
            self.docs.updateValue((doc,), state)
        self.seen.update((seen,))
        if ready:
            self.early.put([tuple(e[f] for f in FIELDS) for _, e in ready])
        else:
            self.early.clear()
        rows = [(job, doc, *state) for doc, state in changed.items()]
        if rows:
            names = [f.split()[0] for f in STATE.split(", ")]
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    def _waiting(self) -> list[dict[str, Any]]:
        return [dict(zip(FIELDS, e, strict=True)) for e in self.early.get()] if self.early.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = self._waiting()
        for df in rows:
            for e in df[FIELDS].astype(object).to_dict("records"):
                e = {k: list(v) if k == "outcomes" and v is not None else None if v is None or v != v else v for k, v in e.items()}
                events.append({k: int(v) if k in ("seq", "doc", "done", "total") and v is not None else v for k, v in e.items()})
        yield from self._apply(int(key[0]), events, gaps=False)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.early.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._apply(int(key[0]), self._waiting(), gaps=True)


def fold_stream(events: DataFrame, patience_ms: int = 600_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """A stream of events -> a stream of the documents that changed, with their whole state. The session has to
    name the RocksDB state store. A run that should end with its input (availableNow) has to switch
    spark.sql.streaming.noDataMicroBatches.enabled off, as timers else ask for one batch after the other."""
    return events.groupBy("job").transformWithStateInPandas(ClientFold(patience_ms, keep_ms), STATE, "Update", "ProcessingTime")
