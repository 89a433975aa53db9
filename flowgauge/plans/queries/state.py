"""Fits from states that are merged, against fits over all rows."""

from pyspark.sql import functions as F

from flowgauge.operators import drift, state
from flowgauge.operators.scaling import apply_minmax
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import ALPHA, CENTROIDS, FEATURES, OLD, RANGES, distance_sql, old_flow, scaled_sql

# The old rows come in three parts, of which the last has no row.
_PARTS = ["l_shipdate < TIMESTAMP_NTZ '1995-06-01'", "l_shipdate >= TIMESTAMP_NTZ '1995-06-01'", "l_shipdate < TIMESTAMP_NTZ '1900-01-01'"]


def _parts(rows):
    return [rows.filter(part) for part in _PARTS]


def _merged(spark, sf_dir):
    return state.merge_features(*[state.feature_state(part, FEATURES) for part in _parts(old_flow(spark, sf_dir))])


@query(f"WITH {OLD} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS ordinal, min({c}) AS low, max({c}) AS high FROM old" for i, c in enumerate(FEATURES)))
def merged_minmax(spark, sf_dir):
    return state.baseline_of(_merged(spark, sf_dir)).scaler


@query(f"""WITH {OLD}, sized AS (SELECT label, count(*) AS n FROM old GROUP BY label)
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS idx, n, round(greatest(1e0, least(8.2e0,
CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n))), 6) AS weight FROM sized""")
def merged_weights(spark, sf_dir):
    return state.baseline_of(_merged(spark, sf_dir)).weights.withColumn("weight", F.round("weight", 6))


@query(f"WITH {OLD} " + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, count({c}) AS n_values, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std "
    "FROM old GROUP BY label" for c in FEATURES))
def merged_moments(spark, sf_dir):
    found = state.moments_of(_merged(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"""WITH {OLD}, {RANGES}, {scaled_sql('old', 'old_s')}, {CENTROIDS}, {distance_sql('old_s', 'old_d')},
fit AS (SELECT count(*) AS n_rows, avg(distance) AS mean_distance, stddev_pop(distance) AS std_distance,
avg(distance) + {ALPHA}e0 * stddev_pop(distance) AS ci_threshold FROM old_d),
bins AS (SELECT floor(log2(distance) * {state.BINS}) AS bin, count(*) AS n, count(*) FILTER (WHERE distance > ci_threshold) AS beyond
FROM old_d, fit WHERE distance > 0 GROUP BY 1)
SELECT n_rows, round(mean_distance, 6) AS mean_distance, round(std_distance, 6) AS std_distance,
round(ci_threshold, 6) AS ci_threshold, CAST(sum(CASE WHEN beyond = n THEN n WHEN beyond > 0 THEN 1 ELSE 0 END) AS BIGINT) AS beyond_least,
CAST(sum(CASE WHEN beyond = n THEN n WHEN beyond > 0 THEN n - 1 ELSE 0 END) AS BIGINT) AS beyond_most FROM bins, fit GROUP BY ALL""")
def merged_threshold(spark, sf_dir):
    """Threshold of all old rows from the distance states of their parts, and the bounds
    of the number of rows beyond it."""
    scaler, centroids = drift.ranges_and_class_means(old_flow(spark, sf_dir), FEATURES, "label")
    parts = [apply_minmax(part, scaler) for part in _parts(old_flow(spark, sf_dir))]
    first = drift.fit_drift(parts[0], FEATURES, alpha=ALPHA, centroids=centroids)
    found = state.threshold_of(state.merge_distances(*[state.distance_state(part, first) for part in parts]), ALPHA)
    return found.drop("beyond").withColumns({c: F.round(c, 6) for c in ("mean_distance", "std_distance", "ci_threshold")})
