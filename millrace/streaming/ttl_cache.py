"""The latest-wins cache as a stream: state keeps the last written row of each key and forgets it after its time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepLatest(StatefulProcessor):
    """Holds one (written, value) a key; emits the key's row whenever a later one arrives."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "written long, value string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.held.get() if self.held.exists() else None
        best = tuple(old) if old is not None else None
        for pdf in rows:
            for row in zip(pdf["written"].tolist(), pdf["value"].tolist(), strict=True):
                if best is None or row >= best:
                    best = row
        if best is not None and (old is None or best != tuple(old)):
            self.held.update(best)
            yield pd.DataFrame({"key": [key[0]], "written": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def latest_by_key(puts: DataFrame, ttl_ms: int) -> DataFrame:
    """A stream of puts (key string, written long, value string) as a stream of updates; needs the RocksDB state store."""
    puts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return puts.groupBy("key").transformWithStateInPandas(KeepLatest(ttl_ms), "key string, written long, value string", "Update", "ProcessingTime")
