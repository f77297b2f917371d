"""Signatures that follow a stream of (table_name, column_name, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sets import KEY
from ..operators.sketches import NUM_PERM, signatures


def maintain(stream: DataFrame, path: str, checkpoint: str, *, num_perm: int = NUM_PERM, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's partial signatures to path/batch=n; minima merge, in any order.

    A batch that is run again overwrites its own folder, so restarts neither lose nor repeat rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        signatures(batch.where("value is not null"), num_perm).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(read: Callable[[str], DataFrame], path: str, num_perm: int = NUM_PERM) -> DataFrame:
    """The merged signatures of all batches so far."""
    return read(path).groupBy(*KEY).agg(F.array(*(F.min(F.col("signature")[i]) for i in range(num_perm))).alias("signature"))
