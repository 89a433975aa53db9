"""Outlier ratio per time window; the same plan over a batch or a stream."""

from pyspark.sql import functions as F

from flowgauge.operators.drift import is_outlier, ratio_test, with_distance


def windowed_drift(df, drift, time, window="1 day", slide=None, watermark=None, by=()):
    """(by ..., window_start, n_rows, n_outliers, outlier_ratio, or_value, drifted) per window,
    and per source where ``by`` names its columns.

    The state per window is two counters, combined map-side, so a window with most
    of the rows costs no more than another. ``watermark`` bounds late rows on a
    stream and lets finished windows leave the state.
    """
    # Zone-free times are refused by watermarks.
    scored = with_distance(df.withColumn(time, F.col(time).cast("timestamp")), drift.features, drift.centroids)
    if watermark:
        scored = scored.withWatermark(time, watermark)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = scored.groupBy(*by, span.alias("_window")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(is_outlier(drift)).alias("n_outliers"))
    measured = counted.select(*by, F.col("_window.start").alias("window_start"), "n_rows", "n_outliers",
                              (F.col("n_outliers") / F.col("n_rows")).alias("outlier_ratio"))
    return ratio_test(measured, drift)


def start_monitor(stream, drift, time, path, checkpoint, window="1 day", watermark="1 hour", trigger=None):
    """Append each finished window to Parquet; returns the running query.

    ``checkpoint`` must be on storage all executors share, for recovery.
    """
    writer = (windowed_drift(stream, drift, time, window, watermark=watermark)
              .writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
