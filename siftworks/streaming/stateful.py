"""Streaming forms: dedup with expiry by processing time, the saturating fold, the queue (T1s, T3s, T5s)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from siftworks.operators.folds import CAP
from siftworks.operators.routing import route
from siftworks.sources.store import TableStore


def first_sights(stream: DataFrame, key: str = "url", ttl_days: float = 35) -> DataFrame:
    """(key, n) of each key when it is first seen, and again when its mark has expired. A second sight does not renew the mark; expiry is by processing time, as event time may stand still."""
    ttl = int(ttl_days * 86_400_000)

    def run(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows)
        if state.hasTimedOut:
            state.remove()
            return
        if not state.exists:
            state.update((1,))
            state.setTimeoutDuration(max(1, ttl))
            yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def saturating_totals(stream: DataFrame, keys: list[str], order: str, delta: str, cap: float = CAP) -> DataFrame:
    """keys and total, for each key that a batch touches: deltas added in order within the batch, held within the cap after each one. Agrees with the batch fold when batches come in order."""
    def run(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for d in pd.concat(list(rows)).sort_values([order, delta], kind="stable")[delta]:
            total = round(max(-cap, min(cap, total + float(d))), 6)
        state.update((total,))
        yield pd.DataFrame([[*k, total]], columns=[*keys, "total"])

    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in keys)
    return stream.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, total double", "total double", "update", GroupStateTimeout.NoTimeout)


def queue_stream(updates: DataFrame, store: TableStore, checkpoint: str, now_iso: str) -> StreamingQuery:
    """Moves all waiting updates that are new messages into the queue, and ends (S19, S22, T4s, T5s). Keys come from update ids, so a batch that is replayed adds nothing."""
    from siftworks.operators.routing import queue_rows

    def put(batch: DataFrame, epoch: int) -> None:
        store.upsert("adhoc_queue", queue_rows(route(batch, store.read("pending_resume")), now_iso))

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
