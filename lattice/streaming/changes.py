"""Sources that grow: a stream of new rows drops what the engine remembers of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattice.engine import Engine


def watch(engine: Engine, source: str, changes: DataFrame, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Append each micro-batch of `changes` to `path` (where given) and tell the engine that the source has changed."""

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            if path is not None:
                batch.write.mode("append").parquet(path)
            engine.notify_changed(source)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
