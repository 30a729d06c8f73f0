"""Passengers on board of each trip, kept as stream state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Workers get the functions below with the task; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = ("trip_id string, stop_sequence int, boarded bigint, alighted bigint, on_board bigint, "
          "corrected boolean")
STATE = "stops array<int>, boarded array<bigint>, alighted array<bigint>"
KEPT_AFTER_LAST_EVENT_MS = 6 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, expires: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known = {s: (b, a) for s, b, a in zip(*state.get)} if state.exists else {}
    told, first = set(known), None
    for batch in batches:
        stops, place = np.unique(batch["stop_sequence"].to_numpy(), return_inverse=True)
        sums = np.zeros((2, len(stops)), dtype=np.int64)
        np.add.at(sums[0], place, batch["boarded"].to_numpy())
        np.add.at(sums[1], place, batch["alighted"].to_numpy())
        for stop, boarded, alighted in zip(stops.tolist(), *sums.tolist()):
            before = known.get(stop, (0, 0))
            known[stop] = (before[0] + boarded, before[1] + alighted)
        first = stops[0] if first is None else min(first, stops[0])
    stops = sorted(known)
    boarded, alighted = ([known[s][side] for s in stops] for side in (0, 1))
    state.update((stops, boarded, alighted))
    if expires:
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + KEPT_AFTER_LAST_EVENT_MS)
    loads = pd.DataFrame({
        "trip_id": key[0], "stop_sequence": stops, "boarded": boarded, "alighted": alighted,
        "on_board": np.cumsum(np.subtract(boarded, alighted)), "corrected": [s in told for s in stops]})
    yield loads[loads["stop_sequence"] >= first]


def onboard_stream(events: DataFrame, watermark: str | None = "2 hours") -> DataFrame:
    """Running load per trip, over events that come in any order of stops.

    The state of a trip is one pair of sums per stop.  An event changes the load of its own
    stop and of all later ones, so these are given out again, marked as corrected where they
    had been given out before; the last row of a stop counts.  Missing counts are 0; events
    without a stop number have no place on the trip and are left out.

    With a watermark the state leaves six hours after the trip's last event, and events behind
    the watermark are dropped.  Without one it stays, for streams that end.

    This gives corrections as they happen, at a call of Python per trip and micro-batch.  Where
    the latest load is enough, ``network.stop_sums`` on the stream, ``ingest.drain_latest`` and
    ``network.load_along`` stay in the JVM.
    """
    timed = events.filter("stop_sequence IS NOT NULL").select(
        "trip_id", "stop_sequence", F.coalesce("boarding_count", F.lit(0)).cast("long").alias("boarded"),
        F.coalesce("alighting_count", F.lit(0)).cast("long").alias("alighted"),
        F.col("event_timestamp").cast("timestamp").alias("event_time"))
    if watermark is not None:
        timed = timed.withWatermark("event_time", watermark)
    expires = watermark is not None
    timeout = GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout
    return timed.groupBy("trip_id").applyInPandasWithState(
        partial(_advance, expires=expires), OUTPUT, STATE, "append", timeout)
