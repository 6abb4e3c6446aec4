"""Fitted pipelines on streams: the same plan where every operation works row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.pipeline import Pipeline


def unstreamable(pipeline: Pipeline) -> list[str]:
    """Operations that need all rows (row-based windows, samples of n rows)."""
    return [type(o).__name__ for o in pipeline._fitted() if not o.streams]


def transform_stream(pipeline: Pipeline, stream: DataFrame, *, watermark: tuple[str, str] | None = None, dedup: list[str] | None = None) -> DataFrame:
    """The pipeline over a stream. ``watermark`` (column, delay) bounds the state of ``dedup`` by these columns."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use transform")
    if watermark:
        stream = stream.withWatermark(*watermark)
    if dedup:
        if not watermark:
            raise ValueError("dedup on a stream needs a watermark, or its state grows for ever")
        stream = stream.dropDuplicatesWithinWatermark(dedup)
    return pipeline.transform(stream)


def write_stream(df: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append to files, exactly once by the checkpoint."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
