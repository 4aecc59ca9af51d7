"""Detection on each micro-batch of a stream (``foreachBatch``).

The detector needs every point of a batch at once (a point's label depends on
its neighbours), so each micro-batch is detected as a whole and its outliers
are written to ``<output>/batch_id=<n>``.  The write overwrites that one
folder, so a batch replayed after a failure replaces its earlier output
instead of duplicating it; together with the stream checkpoint this gives
exactly-once output per batch.  No state is kept between batches.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..session import scratch_path


def detect_stream(stream: DataFrame, features: list[str], eps: float, min_pts: int, id_col: str,
                  output_path: str, checkpoint_location: str | None = None,
                  available_now: bool = True, **kw) -> StreamingQuery:
    """Start a streaming query that writes each batch's outliers as parquet."""
    spark = stream.sparkSession
    ckpt = checkpoint_location or scratch_path(spark, "stream-checkpoint")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        det = detect(batch, features, eps, min_pts, id_col, **kw)
        try:
            # readers take batch_id from the folder's name
            det.outliers.write.mode("overwrite").parquet(os.path.join(output_path, f"batch_id={batch_id}"))
        finally:
            det.release()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
