"""Ledgers as streams (an extension: append-only logs consumed as they grow).

State per ledger is its last hash and count, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from probatum.operators.chain import ZERO

FAULTS = "ledger string, n long, fault string"


def _check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, last = state.get if state.exists else (0, ZERO)
    out = []
    rows = pd.concat(list(batches)).sort_values("n", kind="stable")
    for n, raw, prev in zip(rows["n"], rows["raw"], rows["prev_hash"]):
        fault = "reordered" if n != count else "edited" if prev != last else None
        if fault:
            out.append((key[0], int(n), fault))
        count, last = int(n) + 1, hashlib.sha256((raw or "").encode()).hexdigest()
    state.update((count, last))
    yield pd.DataFrame(out, columns=["ledger", "n", "fault"])


def chain_faults(lines: DataFrame) -> DataFrame:
    """Faults of a stream of lines(ledger, n, raw, prev_hash), each as soon as its line arrives."""
    return lines.groupBy("ledger").applyInPandasWithState(_check, FAULTS, "count long, last string", "append", GroupStateTimeout.NoTimeout)


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was = state.get[0] if state.exists else None
    out = []
    for at, value in pd.concat(list(batches)).sort_values("at", kind="stable")[["at", "value"]].itertuples(index=False):
        if value != was:
            out.append((key[0], int(at), value))
            was = value
    state.update((was,))
    yield pd.DataFrame(out, columns=["identity", "at", "value"])


def changed_states(events: DataFrame) -> DataFrame:
    """Only the events of a stream(identity, at, value) that change an identity's value."""
    return events.groupBy("identity").applyInPandasWithState(_changed, "identity string, at long, value string", "value string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per kind and window; events later than the watermark are left out, as the stream's contract says."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
