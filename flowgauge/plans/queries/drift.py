"""Drift baseline and checks."""

import uuid

from pyspark.sql import functions as F

from flowgauge.operators import drift
from flowgauge.operators.centre_index import index_centres
from flowgauge.operators.coreset import coreset_centroids
from flowgauge.operators.scaling import apply_minmax, fit_minmax
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import (ALPHA, CENTROIDS, DRIFT, FEATURES, FLOW, KEY_LIST, KEYS, OLD, OLD_NEW, RANGES, SHORT,
                                  distance_sql, flow, new_flow, old_flow, scaled_sql, table)
from flowgauge.session import shared_folder, stored
from flowgauge.streaming import response
from flowgauge.streaming.monitor import windowed_drift


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def _fitted(spark, sf_dir):
    """(scaler, centroids): ranges of the old rows and their scaled class means."""
    return drift.ranges_and_class_means(old_flow(spark, sf_dir), FEATURES, "label")


def _baseline(spark, sf_dir):
    scaler, centroids = _fitted(spark, sf_dir)
    old = apply_minmax(old_flow(spark, sf_dir), scaler)
    return scaler, drift.fit_drift(old, FEATURES, alpha=ALPHA, centroids=centroids)


@query(f"""WITH {DRIFT} SELECT fresh.n_rows, n_outliers, round(fresh.ratio, 6) AS outlier_ratio,
round(base.ratio, 6) AS base_outlier_ratio, round(fresh.ratio / base.ratio, 6) AS or_value,
fresh.ratio / base.ratio > 2 AS drifted FROM fresh, base""")
def drift_check(spark, sf_dir):
    """Has the new window drifted? Old rows set ranges, centroids and threshold."""
    scaler, baseline = _baseline(spark, sf_dir)
    new = apply_minmax(new_flow(spark, sf_dir, price_factor=1.5), scaler)
    return _rounded(drift.check_drift(new, baseline), "outlier_ratio", "base_outlier_ratio", "or_value")


@query(f"""WITH {DRIFT} SELECT n_rows, round(mean_distance, 6) AS mean_distance,
round(std_distance, 6) AS std_distance, round(ci, 6) AS ci_threshold FROM fit""")
def drift_threshold(spark, sf_dir):
    scaler, centroids = _fitted(spark, sf_dir)
    distances = drift.with_distance(apply_minmax(old_flow(spark, sf_dir), scaler), FEATURES, centroids)
    return _rounded(drift.distance_threshold(distances, ALPHA), "mean_distance", "std_distance", "ci_threshold")


@query(f"""WITH {OLD}, {RANGES}, {scaled_sql('old', 'old_s')}, {scaled_sql('flow', 'flow_s')}, {CENTROIDS},
{distance_sql('flow_s', 'flow_d')} SELECT {KEY_LIST}, round(distance, 6) AS distance FROM flow_d""")
def nearest_centroid_distance(spark, sf_dir):
    scaler, centroids = _fitted(spark, sf_dir)
    scaled = apply_minmax(flow(spark, sf_dir), scaler, KEYS)
    return _rounded(drift.with_distance(scaled, FEATURES, centroids).select(*KEYS, "distance"), "distance")


@query(f"WITH {DRIFT} SELECT n_rows, n_outliers, round(ratio, 6) AS outlier_ratio FROM fresh")
def outlier_ratio(spark, sf_dir):
    scaler, baseline = _baseline(spark, sf_dir)
    new = apply_minmax(new_flow(spark, sf_dir, price_factor=1.5), scaler)
    distances = drift.with_distance(new, FEATURES, baseline.centroids)
    return _rounded(drift.outlier_ratio(distances, baseline.ci_threshold), "outlier_ratio")


@query(f"""WITH {DRIFT} SELECT CAST(4 AS BIGINT) AS k_clusters, {ALPHA}e0 AS alpha, round(ci, 6) AS ci_threshold,
round(CASE WHEN base.ratio = 0 THEN 1e-9 ELSE base.ratio END, 6) AS base_outlier_ratio, 2e0 AS or_threshold_t,
base.ratio = 0 AS base_was_zero, round(mean_distance, 6) AS mean_distance,
round(std_distance, 6) AS std_distance, n_rows FROM fit, base""")
def drift_baseline(spark, sf_dir):
    _, baseline = _baseline(spark, sf_dir)
    return _rounded(baseline.config(spark), "ci_threshold", "base_outlier_ratio", "mean_distance", "std_distance")


_FIRST_HALF = "TIMESTAMP '2024-01-16'"
_EVENT_ALPHA = 2.0


def event_baseline(events):
    """Baseline on the value of the first 15 days, around its mean."""
    early = events.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    mean = early.agg(F.avg("value")).first()[0]
    return drift.fit_drift(early, ["value"], alpha=_EVENT_ALPHA, centroids=[[mean]])


@query(f"""WITH early AS (SELECT value FROM events WHERE ts < {_FIRST_HALF}),
middle AS (SELECT avg(value) AS c FROM early),
fit AS (SELECT avg(abs(value - c)) + {_EVENT_ALPHA}e0 * stddev_pop(abs(value - c)) AS ci FROM early, middle),
base AS (SELECT avg(CASE WHEN abs(value - c) > ci THEN 1e0 ELSE 0e0 END) AS ratio FROM early, middle, fit),
days AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows,
count(*) FILTER (WHERE abs(value - c) > ci) AS n_outliers FROM events, middle, fit GROUP BY 1)
SELECT CAST(window_start AS VARCHAR) AS window_start, n_rows, n_outliers,
round(n_outliers / n_rows, 6) AS outlier_ratio, round(ratio, 6) AS base_outlier_ratio,
round(n_outliers / n_rows / ratio, 6) AS or_value, n_outliers / n_rows / ratio > 2 AS drifted FROM days, base""")
def drift_by_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "value")
    windows = windowed_drift(events, event_baseline(events), "ts")
    windows = windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return _rounded(windows, "outlier_ratio", "base_outlier_ratio", "or_value")


@query(f"""WITH {OLD} SELECT CAST(50 AS BIGINT) AS k_clusters, {ALPHA}e0 AS alpha, 2e0 AS or_threshold_t,
count(*) AS n_rows, true AS centres_in_range, true AS threshold_follows, true AS share_follows FROM old""")
def kmeans_baseline(spark, sf_dir):
    """The record with centres clustered from a coreset of all rows, and whether threshold and base share are those
    of the distances to the centres it returns."""
    old = old_flow(spark, sf_dir)
    scaled = apply_minmax(old, fit_minmax(old, FEATURES))
    fitted = drift.fit_drift(scaled, FEATURES, alpha=ALPHA, partitions=spark.sparkContext.defaultParallelism, clustering="coreset")
    gaps = [[(F.col(c) - v) ** 2 for c, v in zip(FEATURES, point)] for point in fitted.centroids]
    distance = F.sqrt(F.array_min(F.array(*[sum(squares[1:], squares[0]) for squares in gaps]))).alias("distance")
    beyond = F.avg(F.when(F.col("distance") > fitted.ci_threshold, 1.0).otherwise(0.0))
    found = scaled.select(distance).agg((F.avg("distance") + ALPHA * F.stddev_pop("distance")).alias("ci"), beyond.alias("share"))
    inside = all(-1e-6 <= v <= 1 + 1e-6 for point in fitted.centroids for v in point)
    return fitted.config(spark).join(found).select(
        "k_clusters", "alpha", "or_threshold_t", "n_rows", F.lit(inside).alias("centres_in_range"),
        (F.abs(F.col("ci") - F.col("ci_threshold")) < 1e-6).alias("threshold_follows"),
        (F.abs(F.col("share") - F.when(F.col("base_was_zero"), 0.0).otherwise(F.col("base_outlier_ratio"))) < 1e-6).alias("share_follows"))


@query(f"""WITH {OLD} SELECT count(*) AS n_rows, CAST(50 AS BIGINT) AS k_clusters, true AS cost_within_5_percent FROM old""")
def coreset_cost(spark, sf_dir):
    """Whether centres from one pass cost at most 5% more, over all rows, than those of
    up to 300 iterations over all rows."""
    old = old_flow(spark, sf_dir)
    scaled = stored(apply_minmax(old, fit_minmax(old, FEATURES)), "scaled")
    cores = spark.sparkContext.defaultParallelism
    fits = {"one_pass": coreset_centroids(scaled, FEATURES, drift.CLUSTERS, partitions=cores),
            "iterated": drift.fit_centroids(scaled, FEATURES, partitions=cores)}
    for name, centres in fits.items():
        scaled = drift.with_distance(scaled, FEATURES, centres, name)
    within = F.sum(F.pow("one_pass", 2)) <= 1.05 * F.sum(F.pow("iterated", 2))
    return scaled.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(fits["one_pass"])).cast("long").alias("k_clusters"), within.alias("cost_within_5_percent"))


_ORDER_MEANS = ", ".join(f"avg({s}) AS c{s}" for s in SHORT.values())
_ORDER_GAPS = " + ".join(f"(p.{s} - c{s}) * (p.{s} - c{s})" for s in SHORT.values())


@query(f"""WITH {FLOW}, {RANGES.replace('FROM old', 'FROM flow')}, {scaled_sql('flow', 'flow_s')},
centroids AS (SELECT l_orderkey, {_ORDER_MEANS} FROM flow_s GROUP BY l_orderkey),
points AS (SELECT *, row_number() OVER () AS point FROM flow_s WHERE l_orderkey % 20 = 0)
SELECT {', '.join('p.' + k for k in KEYS)}, round(min(sqrt({_ORDER_GAPS})), 6) AS distance
FROM points p, centroids GROUP BY p.point, {', '.join('p.' + k for k in KEYS)}""")
def centre_index_distance(spark, sf_dir):
    """A search: lines of every twentieth order against the mean lines of all orders,
    through an index over the means."""
    rows = flow(spark, sf_dir)
    scaled = apply_minmax(rows, fit_minmax(rows, FEATURES), KEYS)
    means = scaled.groupBy("l_orderkey").agg(F.array(*[F.avg(c) for c in FEATURES]).alias("centroid"))
    index = index_centres(means.withColumnRenamed("l_orderkey", "cluster"), len(FEATURES))
    found = index.with_nearest(scaled.filter("l_orderkey % 20 = 0"), FEATURES)
    return _rounded(found.select(*KEYS, "distance"), "distance")


# Two kinds of events grow threefold in the last third, so that there is something to confirm.
_GROWN = "CASE WHEN ts >= TIMESTAMP '2024-01-20' AND event_type IN ('error', 'signup') THEN 3e0 * value ELSE value END"
_IN_A_ROW = 3


def _confirmed_sql(finished):
    return f"""WITH grown AS (SELECT ts, event_type, {_GROWN} AS value FROM events),
early AS (SELECT value FROM grown WHERE ts < {_FIRST_HALF}),
middle AS (SELECT avg(value) AS c FROM early),
fit AS (SELECT avg(abs(value - c)) + {_EVENT_ALPHA}e0 * stddev_pop(abs(value - c)) AS ci FROM early, middle),
base AS (SELECT avg(CASE WHEN abs(value - c) > ci THEN 1e0 ELSE 0e0 END) AS ratio FROM early, middle, fit),
days AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) FILTER (WHERE abs(value - c) > ci) / count(*) AS share
FROM grown, middle, fit WHERE {finished} GROUP BY ALL),
tested AS (SELECT event_type, day, share / ratio AS or_value, share / ratio > 2 AS drifted FROM days, base),
runs AS (SELECT *, count(*) FILTER (WHERE NOT drifted) OVER (PARTITION BY event_type ORDER BY day) AS run FROM tested),
placed AS (SELECT *, row_number() OVER w AS place, min(day) OVER w AS first_day FROM runs WHERE drifted
WINDOW w AS (PARTITION BY event_type, run ORDER BY day))
SELECT event_type, strftime(first_day, '%Y-%m-%d') AS first_window, strftime(day, '%Y-%m-%d') AS window_start,
round(or_value, 6) AS or_value FROM placed WHERE place = {_IN_A_ROW}"""


def _grown_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("ts", "event_type", F.expr(_GROWN.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")).alias("value"))


def _days(events):
    return _rounded(events.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_window", "window_start")}), "or_value")


@query(_confirmed_sql("true"))
def drift_confirmed(spark, sf_dir):
    """Per kind of event, the days that confirm a drift: the third in a row that has drifted."""
    events = _grown_events(spark, sf_dir)
    windows = windowed_drift(events, event_baseline(events), "ts", by=["event_type"])
    return _days(response.confirmed_drift(windows, "event_type", _IN_A_ROW))


@query(_confirmed_sql("date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM grown)"))
def drift_confirmed_stream(spark, sf_dir):
    """The same from a stream of the events, for the days that the watermark has closed."""
    events = _grown_events(spark, sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    windows = windowed_drift(stream, event_baseline(events), "ts", watermark="1 hour", by=["event_type"])
    confirmed = response.confirmed_drift(windows, "event_type", _IN_A_ROW)
    writer = confirmed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    running = response.started(writer.trigger(availableNow=True), spark)
    running.awaitTermination()
    return _days(spark.read.schema(confirmed.schema).parquet(f"{folder}/out"))
