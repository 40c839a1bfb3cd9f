"""The expanding history of edges as a stream: mean and variance of an edge's earlier speeds, with each of its rows.

Each edge's state is the number, the mean and the squared deviations of its speeds so far, and the time of the last. The rows of an edge in a
micro-batch are taken in order of time. A row that is not after the edge's last one comes too late: it leaves the state as it is and
gets no history, and is marked. A null speed is passed on with its history and not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROWS = "edge_id string, timestamp timestamp, speed_mph double, hist_mean_speed double, hist_var_speed double, late boolean"
STATE = "n long, mean double, squares double, last timestamp"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, squares, last = state.get if state.exists else (0, 0.0, 0.0, None)
    last = None if last is None else pd.Timestamp(last)
    rows, out = pd.concat(list(batches)).sort_values("timestamp", kind="stable"), []
    for when, speed in zip(rows["timestamp"], rows["speed_mph"], strict=True):
        late = last is not None and when <= last
        known = not late and n > 0
        out.append((key[0], when, speed, mean if known else None, squares / (n - 1) if known and n > 1 else None, late))
        if not late:
            last = when
            if not pd.isna(speed):
                n += 1
                away = speed - mean
                mean += away / n
                squares += away * (speed - mean)
    state.update((n, mean, squares, None if last is None else last.to_pydatetime()))
    yield pd.DataFrame(out, columns=["edge_id", "timestamp", "speed_mph", "hist_mean_speed", "hist_var_speed", "late"])


def expanding_history(stream: DataFrame) -> DataFrame:
    """edge_id, timestamp, speed_mph of a stream with hist_mean_speed and hist_var_speed over the edge's earlier rows, and late."""
    rows = stream.selectExpr("edge_id", "cast(timestamp AS timestamp) AS timestamp", "speed_mph")
    return rows.groupBy("edge_id").applyInPandasWithState(_advance, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
