"""The best row of each key as running state that says when it changes, is bounded in time and is cleared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestSoFar(StatefulProcessor):
    """State of a key: its best score and order so far, and when the state goes; a row goes out only when it is better."""

    def __init__(self, keys: list[str], score: str, order: str, keep: list[str], time: str, idle: int) -> None:
        self.keys, self.score, self.order, self.keep, self.time, self.idle = keys, score, order, keep, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "score double, place bigint, until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.best.get() if self.best.exists() else None
        score, place, until = (held[0], held[1], held[2]) if held else (float("-inf"), 0, 0)
        latest, winner = until, None
        for pdf in rows:
            s = pdf[self.score].fillna(0.0).astype(float)
            first = pdf.assign(_s=s).sort_values(["_s", self.order], ascending=[False, True]).iloc[0]
            if held is None and winner is None or (first["_s"], -first[self.order]) > (score, -place):
                score, place, winner = float(first["_s"]), int(first[self.order]), first
            latest = max(latest, int(pdf[self.time].max().timestamp() * 1000) + self.idle)
        if latest > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.best.update((score, place, latest))
        if winner is not None:
            yield pd.DataFrame([{**dict(zip(self.keys, key, strict=True)), **{k: winner[k] for k in self.keep}, self.score: score, self.order: place}])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.best.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def best_changes(events: DataFrame, keys: list[str], score: str, order: str, keep: list[str], time: str, late: str = "7 days", idle_days: float = 30.0) -> DataFrame:
    """A stream of changes: each key's row whenever it is better than all before (a missing score is 0; ties by the least order).

    For append mode. A key's state is three numbers and a timer in event time; it goes when the watermark is `idle_days` past
    the key's last event, and a row that comes later still begins anew. So state is as large as the keys of that time, and
    the best of all rows that went out for a key is its best row. Needs the RocksDB state store, which is set here.
    """
    spark = events.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = StructType.fromDDL(", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *keep]) + f", `{score}` double, `{order}` bigint")
    rows = events.select(*dict.fromkeys([*keys, score, order, *keep, time])).withWatermark(time, late)
    return rows.groupBy(*keys).transformWithStateInPandas(BestSoFar(keys, score, order, keep, time, round(idle_days * 86_400_000)), out, "Append", "EventTime")
