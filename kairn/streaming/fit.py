"""Clustering of unbounded streams, with the state machine kept per stream between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import EngineConfig
from ..operators.stepper import FrameStepper, Stopped

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "frame_id long, cluster_id long, dist double, is_new boolean, n_evals int, pruned long, late boolean"


class ClusterProcessor(StatefulProcessor):
    """State: the stepper and the last frame seen. Bounded by maxcl, maxvis and the prediction horizon."""

    def __init__(self, config: EngineConfig, key: str, kind: str):
        self.config, self.key, self.kind = config, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stepper", "blob binary, last long, stopped boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stepper, last, stopped = FrameStepper(self.config), -1, False
        if self.state.exists():
            blob, last, stopped = self.state.get()
            stepper = pickle.loads(bytes(blob))  # our own state, written below
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_id", kind="stable").itertuples():
            if r.frame_id <= last:
                out.append((r.frame_id, -1, None, False, 0, 0, True))
                continue
            last = r.frame_id
            if stopped or r.data is None:
                continue
            try:
                s = stepper.step(np.asarray(r.data, float))
            except Stopped:
                stopped = True
                continue
            out.append((r.frame_id, s.cluster, s.dist, s.new, len(s.evals), s.pruned, False))
        self.state.update((pickle.dumps(stepper), int(last), stopped))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        frame.insert(0, self.key, key[0])
        yield frame

    def close(self) -> None:
        pass


def fit_stream(frames: DataFrame, config: EngineConfig, by: str) -> DataFrame:
    """Online membership of a streaming DataFrame (by, frame_id, data): OUT's columns after the key.

    Rows of a micro-batch are taken in order of frame_id, so the result doesn't depend on how a stream
    is cut into batches. Frames at or behind the last one are late: they are reported, not clustered.
    cluster_id is a creation number and never changes. The session has to use the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass = STORE).
    """
    kind = dict(frames.dtypes)[by]
    return frames.select(by, "frame_id", "data").groupBy(by).transformWithStateInPandas(
        ClusterProcessor(config, by, kind), f"`{by}` {kind}, {OUT}", "Append", "None"
    )


def missed_frames(membership: DataFrame, by: str) -> DataFrame:
    """Gaps in frame_id of each stream: (by, after, missed)."""
    from pyspark.sql import functions as F

    from ..functions.ordered import lagged

    gaps = lagged(membership.select(by, "frame_id"), {"frame_id": "after"}, by=[by]).where("after IS NOT NULL AND frame_id > after + 1")
    return gaps.select(by, "after", (F.col("frame_id") - F.col("after") - 1).alias("missed"))
