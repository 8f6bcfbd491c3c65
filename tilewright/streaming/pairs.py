"""Temporal pairs over a stream of scenes, with the last scene of each sequence as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "before_id string, after_id string, sequence_id string, gap_days int"
_STATE = "last_id string, last_ms long, waiting_ids array<string>, waiting_ms array<long>"
_DAY = 86_400_000


def _released(last: tuple[str | None, int], rows: list[tuple[int, str]], sequence: str, most_days: int) -> tuple[list[tuple], tuple[str | None, int]]:
    """Pairs of ``rows`` (milliseconds, id), in order, after the last scene; and the scene that is last now."""
    out = []
    for at, tile in sorted(rows):
        if last[0] is not None:
            gap = at // _DAY - last[1] // _DAY
            if 0 < gap <= most_days:
                out.append((last[0], tile, sequence, gap))
        last = (tile, at)
    return out, last


def stream_pairs(scenes: DataFrame, most_days: int, lateness: str | None = None) -> DataFrame:
    """Consecutive pairs of ``scenes(sequence_id, tile_id, timestamp)``.

    Without ``lateness`` scenes of a sequence must arrive in order; one that is older than the last is an error, as its
    pair has gone out wrong. With it (an interval) scenes wait in state until the watermark has passed them, so any order
    within that time gives the batch's pairs, and a sequence whose last scene is too old for a pair is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_id, last_ms, ids, times = state.get if state.exists else (None, 0, [], [])
        waiting = list(zip(times, ids, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting += zip((int(t) for t in frame["ms"]), frame["tile_id"], strict=True)
        if lateness is None:
            if last_id is not None and any(row < (last_ms, last_id) for row in waiting):
                raise ValueError(f"a scene of sequence {key[0]} came after a later one")
            ready, waiting = waiting, []
        else:
            mark = state.getCurrentWatermarkMs()
            ready, waiting = [r for r in waiting if r[0] <= mark], [r for r in waiting if r[0] > mark]
        out, (last_id, last_ms) = _released((last_id, last_ms), ready, key[0], most_days)
        if lateness is not None and not waiting and (last_id is None or last_ms + (most_days + 1) * _DAY <= mark):
            state.remove()  # nothing that is still to come makes a pair with it
        else:
            state.update((last_id, last_ms, [t for _, t in waiting], [at for at, _ in waiting]))
            if lateness is not None:
                wake = min(waiting)[0] if waiting else last_ms + (most_days + 1) * _DAY
                state.setTimeoutTimestamp(max(wake, mark + 1))
        yield pd.DataFrame(out, columns=["before_id", "after_id", "sequence_id", "gap_days"])

    keyed = scenes.withColumn("ms", F.unix_millis("timestamp"))
    timeout = GroupStateTimeout.NoTimeout
    if lateness is not None:
        keyed, timeout = keyed.withWatermark("timestamp", lateness), GroupStateTimeout.EventTimeTimeout
    return keyed.groupBy("sequence_id").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)
