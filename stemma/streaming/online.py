"""Online forward filter: the chain's filter as a stateful stream.

The forward message at t needs only the one at t - 1, so the state of a key is one small vector.  Events
are ordered by time within each micro-batch; those behind the watermark are dropped, because a message
can't be taken out of a product again.  On input in order the stream ends where the batch query ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stemma.operators.chain import HMM

OUT = "seq_id long, n long, logz double, alpha array<double>"
STATE = "last double, n long, alpha array<double>"


def step(model: HMM, alpha: np.ndarray | None, y: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        like = np.log(np.array(model.e)[:, y])
        if alpha is None:
            return np.log(np.array(model.pi)) + like
        top = alpha.max()
        return np.log(np.exp(alpha - top) @ np.array(model.a)) + top + like


def online_filter(stream: DataFrame, model: HMM, key: str, time: str, y: str, delay: str = "10 minutes", idle: int = 30 * 86_400, mode: str = "append") -> DataFrame:
    """seq_id, n, logz, alpha after each micro-batch, for the keys it touched.  ``time`` is a timestamp.

    A key's state goes ``idle`` seconds of event time after its last event, so the store doesn't grow
    for ever; what comes later starts a new sequence.  ``mode``: that of the query's sink.
    """

    def work(seq: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n, alpha = state.get if state.exists else (-math.inf, 0, None)
        alpha = None if alpha is None else np.array(alpha)
        rows = pd.concat(list(parts)).sort_values([time, y])
        for at, value in zip(rows[time].astype("int64") / 1e9, rows[y], strict=True):
            if at < last:
                continue  # late within the watermark's delay, but already passed
            alpha, last, n = step(model, alpha, int(value)), float(at), n + 1
        state.update((last, n, [float(x) for x in alpha] if alpha is not None else None))
        if alpha is not None:
            state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
            top = alpha.max()
            yield pd.DataFrame([(seq[0], n, float(np.log(np.exp(alpha - top).sum()) + top), [float(x) for x in alpha])], columns=["seq_id", "n", "logz", "alpha"])

    rows = stream.withWatermark(time, delay).select(key, time, y)
    return rows.groupBy(key).applyInPandasWithState(work, OUT, STATE, mode, GroupStateTimeout.EventTimeTimeout)
