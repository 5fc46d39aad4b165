"""Structured Streaming forms: drift per arriving batch and late feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators.series import drift_score, statistical_drift


def drift_per_batch(stream: DataFrame, baseline: DataFrame, features: Sequence[str], output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append one drift score per micro-batch to ``output``.

    Each batch overwrites its own ``batch_id`` folder, so a batch that is run
    again after a failure leaves one score.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        drift_score(statistical_drift(baseline, batch, features)).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def match_feedback(predictions: DataFrame, feedback: DataFrame, within_days: int = 30) -> DataFrame:
    """Join feedback that arrives up to ``within_days`` late to logged predictions.

    Both sides carry a watermark and the join a time range, so state for a
    prediction is dropped once its feedback can no longer arrive.
    ``predictions``: prediction_id, model_id, prediction_ts, prediction;
    ``feedback``: prediction_id, feedback_ts, actual.
    """
    p = predictions.withWatermark("prediction_ts", f"{within_days} days").alias("p")
    f = feedback.withWatermark("feedback_ts", f"{within_days} days").alias("f")
    on = F.expr(f"p.prediction_id = f.prediction_id AND f.feedback_ts >= p.prediction_ts AND f.feedback_ts <= p.prediction_ts + INTERVAL {within_days} DAYS")
    return p.join(f, on).select("p.prediction_id", "p.model_id", "p.prediction_ts", "f.feedback_ts", (F.col("p.prediction") == F.col("f.actual")).cast("int").alias("correct"))


def windowed_accuracy(matched: DataFrame, window: str = "30 days") -> DataFrame:
    """Accuracy per model and window of the feedback time; works on a stream or on the written matches."""
    return matched.groupBy(F.window("feedback_ts", window).alias("w"), "model_id").agg(F.sum("correct").alias("n_correct"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "model_id", "n_correct", "n", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def write_matches(matched: DataFrame, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    return matched.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
