"""Scoring of a stream with a saved field model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import fields


def stream_score(stream: DataFrame, key: str, features: str, model: fields.FieldModel, which: str, path: str,
                 copies: int | None = None) -> DataFrame:
    """Score every micro-batch and write it under its batch number, so that a batch that is run
    again after a failure replaces itself. Returns the scored rows read back."""
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = fields.score(batch, key, features, model, which, copies)
        scored.select(key, "score").write.mode("overwrite").parquet(f"{path}/scores/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/scores").drop("batch")
