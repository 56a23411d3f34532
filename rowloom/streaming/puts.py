"""Put semantics on a stream: the item put last on each key, kept as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from rowloom.streaming.runs import drain

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPut(StatefulProcessor):
    """Holds the order of the last put of each key, and hands on puts that are later than it."""

    def __init__(self, order: str, order_type: StructField, expires_ms: int | None):
        self.order, self.schema, self.expires_ms = order, StructType([order_type]), expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.expires_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = None
        for some in rows:  # however many puts come for one key, only one is held
            top = some.loc[[some[self.order].idxmax()]]
            if best is None or top[self.order].iloc[0] > best[self.order].iloc[0]:
                best = top
        if best is None:
            return
        at = best[self.order].iloc[0]
        if not self.last.exists() or at > self.last.get()[0]:
            self.last.update((at.item() if hasattr(at, "item") else at,))
            yield best

    def close(self) -> None:
        pass


def stream_put_live(
    items: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("stream_id", "timestamp"),
    order: str = "seq",
    expires_ms: int | None = None,
) -> None:
    """Write, batch by batch, the items that are the last put on their key so far.

    A repeated put and one that comes late, behind a later one, write nothing. Only the order
    of each key's last put is state, for ``expires_ms`` after it came, or for good; a key that
    comes after that begins anew. The session needs the RocksDB state store (``STATE_STORE``).
    """
    schema = items.schema
    last = items.groupBy(*keys).transformWithStateInPandas(
        LastPut(order, schema[order], expires_ms), schema, "Update", "ProcessingTime" if expires_ms else "None"
    )
    drain(last, lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"), checkpoint, mode="update")


def read_puts(spark: SparkSession, out: str, keys: Sequence[str] = ("stream_id", "timestamp"), order: str = "seq") -> DataFrame:
    """The item on each key: of those written, the one put last."""
    written = spark.read.parquet(out)
    rest = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "batch_id")).alias("_item"))
    return last.select(*keys, *[F.col(f"_item.{c}").alias(c) for c in rest])
