from pyspark.sql import functions as F

from conftest import rows
from flowgauge.plans.flow import table
from flowgauge.plans.queries.drift import event_baseline
from flowgauge.streaming.monitor import start_monitor, windowed_drift


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("ts", "value")
    baseline = event_baseline(events)
    source = str(tmp_path / "in")
    # In time order, so that the watermark never passes a row that is still to come.
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(source)
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).withColumn("value", F.lit(0.0))
    closing.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = start_monitor(stream, baseline, "ts", str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windowed_drift(events, baseline, "ts")
    assert rows(got, "window_start", "n_rows", "n_outliers", "drifted") == \
        rows(want, "window_start", "n_rows", "n_outliers", "drifted")


def test_sliding_windows_and_drift_flag(spark):
    data = [(f"2024-01-0{d} 12:00:00", float(v)) for d in (1, 2) for v in range(10)]
    data += [("2024-01-03 12:00:00", 100.0)] * 5
    df = spark.createDataFrame(data, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    baseline = event_baseline(df.filter("value < 50").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    daily = windowed_drift(df, baseline, "ts")
    assert [r.drifted for r in daily.orderBy("window_start").collect()] == [False, False, True]
    assert windowed_drift(df, baseline, "ts", "2 days", "1 day").count() == 4
