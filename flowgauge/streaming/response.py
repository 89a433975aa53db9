"""Drift that lasts, per source, and the response to it: once, also after a restart.

A single window can exceed the limit by chance. Drift is confirmed when ``needed`` windows of a
source in a row have drifted (windows without rows do not exist, so they do not
break a row). A run of drifted windows gives one event, however long it gets; the next
event needs a window without drift before it.

``confirmed_drift`` tells the same events from a batch of windows and from a stream of
them. On a stream a source's state is the length and start of its run.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window as W

from flowgauge.sources import store
from flowgauge.streaming.monitor import windowed_drift

NEEDED = 2
# A processor of one's own keeps its state in this store; a query takes it from the session as it starts.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def confirmed_drift(windows, source, needed=NEEDED):
    """(source, first_window, window_start, or_value): the window that confirms a drift, and
    the first of its run, from (source, window_start, or_value, drifted).

    A null source is a source of its own; without windows there are no events. On a stream
    the windows have to come in the order of their starts, as finished windows do, and the
    query is to be started by ``started``, with the store that its state needs."""
    rows = windows.select(source, "window_start", "or_value", "drifted")
    return _of_stream(rows, source, needed) if windows.isStreaming else _of_batch(rows, source, needed)


def _of_batch(rows, source, needed):
    in_order = W.partitionBy(source).orderBy("window_start")
    run = rows.withColumn("_calm", F.count_if(~F.col("drifted")).over(in_order)).filter("drifted")
    place = W.partitionBy(source, "_calm").orderBy("window_start")
    placed = run.withColumn("_place", F.row_number().over(place)).withColumn("first_window", F.first("window_start").over(place))
    return placed.filter(F.col("_place") == needed).select(source, "first_window", "window_start", "or_value")


def _of_stream(rows, source, needed):
    schema = T.StructType([rows.schema[source], T.StructField("first_window", T.TimestampType()),
                           rows.schema["window_start"], rows.schema["or_value"]])
    return rows.groupBy(source).transformWithStateInPandas(Runs(needed, schema.names), schema, "append", "None")


class Runs(StatefulProcessor):
    """Per source, the length and the start of the run of drifted windows it is in."""

    def __init__(self, needed, names):
        self.needed, self.names = needed, names

    def init(self, handle):
        self.state = handle.getValueState("run", "length int, first timestamp")

    def handleInputRows(self, key, rows, timerValues):
        run, first = self.state.get() if self.state.exists() else (0, None)
        events = []
        for window in pd.concat(rows).sort_values("window_start").itertuples(index=False):
            if not window.drifted:
                run, first = 0, None
                continue
            run, first = run + 1, first or window.window_start
            if run == self.needed:
                events.append((key[0], first, window.window_start, window.or_value))
        self.state.update((run, first))
        yield pd.DataFrame(events, columns=self.names)

    def close(self):
        pass


def rows_since(df, events, time, source, window="1 day"):
    """Rows of the sources that drifted, from the first window of the run to the end of the
    window that confirmed it: what a refit learns from. A row counts once however many
    events it belongs to."""
    spans = events.select(F.col(source).alias("_source"), F.col("first_window").alias("_from"),
                          (F.col("window_start") + F.expr(f"INTERVAL {window}")).alias("_to"))
    at = F.col(time).cast("timestamp")
    inside = F.col(source).eqNullSafe(F.col("_source")) & (at >= F.col("_from")) & (at < F.col("_to"))
    return df.join(spans, inside, "left_semi")


def respond_once(events, path, source, refit):
    """Call ``refit`` with the events that no published response has answered yet, and publish
    its detector under ``path`` together with them; returns the version's number.

    None if nothing is new or the response keeps the old detector. Events are published in
    one step with the detector, so a repeated call finds either both or neither."""
    done = store.answered_events(events.sparkSession, path)
    if done is not None:
        done = done.select(F.col(source).alias("_source"), F.col("window_start").alias("_at"))
        events = events.join(done, F.col(source).eqNullSafe(F.col("_source")) & (F.col("window_start") == F.col("_at")), "left_anti")
    if events.isEmpty():
        return None
    response = refit(events)
    return store.save_response(events.sparkSession, response, events, path) if response else None


def start_response(stream, drift, time, source, path, checkpoint, refit, needed=NEEDED, window="1 day",
                   watermark="1 hour", trigger=None):
    """Watch a stream of scaled rows per source and answer each confirmed drift; returns the
    running query.

    ``refit`` takes the events and returns a response (see ``plans.response.respond``, with
    ``gate=False``: the drift is confirmed). Its detector becomes the current one under
    ``path``. A batch that is run again after a failure answers only what is still open.
    ``checkpoint`` must be on storage all executors share.
    """
    windows = windowed_drift(stream, drift, time, window, watermark=watermark, by=[source])

    def answer(batch, _):
        events = batch.persist()
        try:
            events.count()      # all partitions, so that the state of every source is kept
            respond_once(events, path, source, refit)
        finally:
            events.unpersist()

    writer = (confirmed_drift(windows, source, needed).writeStream.foreachBatch(answer)
              .outputMode("append").option("checkpointLocation", checkpoint))
    return started(writer.trigger(**(trigger or {"availableNow": True})), stream.sparkSession)


def started(writer, spark):
    """Start a query on ``confirmed_drift``; the session's own state store setting stays."""
    name, value = _STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)
