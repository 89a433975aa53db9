"""Profiles, quotas, synthetic rows, balance."""

from pyspark.sql import functions as F

from flowgauge.operators import balance, profiles
from flowgauge.operators.labels import fit_labels
from flowgauge.operators.sampling import stratified_split
from flowgauge.plans.baseline import fit_baseline
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import FEATURES, FLOW, KEYS, OLD_NEW, flow, new_flow, old_flow, split_sql

DISCRETE = ["l_quantity", "l_discount", "l_tax"]
CONTINUOUS = ["l_extendedprice"]
CANDIDATES = [*DISCRETE, "l_linenumber", "l_suppkey", "l_extendedprice"]


def _profiles(rows):
    return profiles.fit_profiles(rows, DISCRETE, CONTINUOUS)


@query(f"WITH {FLOW}, counted AS (" + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM flow GROUP BY label" for c in CANDIDATES)
    + ") SELECT label, feature, n_distinct, n_distinct <= 100 AS eligible FROM counted")
def discrete_eligibility(spark, sf_dir):
    return profiles.discrete_eligibility(flow(spark, sf_dir), CANDIDATES)


@query(f"WITH {FLOW} " + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, {c} AS value, count(*) AS n FROM flow GROUP BY label, {c}" for c in DISCRETE))
def class_value_counts(spark, sf_dir):
    return profiles.class_value_counts(flow(spark, sf_dir), DISCRETE)


_NEW_TRAIN = f"{OLD_NEW}, {split_sql('new')}, new_train AS (SELECT * FROM split WHERE split = 'train')"
_QUOTA = """quota AS (SELECT known.label, count(new_train.label) AS quota
FROM (SELECT DISTINCT label FROM old) known LEFT JOIN new_train ON known.label = new_train.label GROUP BY known.label)"""


def _new_train(spark, sf_dir):
    return stratified_split(new_flow(spark, sf_dir), keys=KEYS).filter("split = 'train'")


@query(f"WITH {_NEW_TRAIN}, {_QUOTA} SELECT label, quota FROM quota")
def quota_match(spark, sf_dir):
    return balance.quota_match(_new_train(spark, sf_dir), fit_labels(old_flow(spark, sf_dir)))


@query(f"""WITH {_NEW_TRAIN}, known AS (SELECT DISTINCT label FROM old)
SELECT label, CAST(ceil((SELECT count(*) FROM new_train) / (SELECT count(*) FROM known)) AS BIGINT) AS quota FROM known""")
def quota_equal(spark, sf_dir):
    return balance.quota_equal(_new_train(spark, sf_dir), fit_labels(old_flow(spark, sf_dir)))


@query(f"""WITH {_NEW_TRAIN}, {_QUOTA} SELECT label, quota AS n, true AS quantity_seen, true AS price_in_range
FROM quota WHERE quota > 0""")
def synthetic_counts(spark, sf_dir):
    """Rows drawn per class, and whether they stay within what the class has shown."""
    old = old_flow(spark, sf_dir)
    drawn = profiles.draw(_profiles(old), balance.quota_match(_new_train(spark, sf_dir), fit_labels(old)))
    seen = old.select("label", "l_quantity").distinct().withColumn("_seen", F.lit(True))
    ends = old.groupBy("label").agg(F.min("l_extendedprice").alias("_low"), F.max("l_extendedprice").alias("_high"))
    return drawn.join(seen, ["label", "l_quantity"], "left").join(ends, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce("_seen", F.lit(False))).alias("quantity_seen"),
        F.bool_and(F.col("l_extendedprice").between(F.col("_low"), F.col("_high"))).alias("price_in_range"))


@query(f"""WITH {FLOW}, known AS (SELECT DISTINCT label FROM flow)
SELECT label, CAST(ceil((SELECT count(*) FROM flow) / (SELECT count(*) FROM known)) AS BIGINT) AS n,
0::BIGINT AS n_strange, 0::BIGINT AS n_out_of_range FROM known""")
def synthetic_rows(spark, sf_dir):
    """Rows drawn for equal quotas, and those with a value their class has not shown or
    outside its range."""
    rows = flow(spark, sf_dir)
    drawn = profiles.draw(_profiles(rows), balance.quota_equal(rows, fit_labels(rows)))
    shown = [rows.select("label", c).distinct().withColumn(f"_{c}", F.lit(True)) for c in DISCRETE]
    for c, values in zip(DISCRETE, shown):
        drawn = drawn.join(values, ["label", c], "left")
    ends = rows.groupBy("label").agg(F.min("l_extendedprice").alias("_low"), F.max("l_extendedprice").alias("_high"))
    strange = ~(F.col(f"_{DISCRETE[0]}").isNotNull() & F.col(f"_{DISCRETE[1]}").isNotNull() & F.col(f"_{DISCRETE[2]}").isNotNull())
    return drawn.join(ends, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(strange).alias("n_strange"),
        F.count_if(~F.col("l_extendedprice").between(F.col("_low"), F.col("_high"))).alias("n_out_of_range"))


@query(f"WITH {FLOW}, counts AS (" + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, {c} AS value, count(*) AS n FROM flow GROUP BY label, {c}" for c in DISCRETE)
    + """) SELECT label, feature, value, round(sum(n) OVER (PARTITION BY label, feature ORDER BY value) /
sum(n) OVER (PARTITION BY label, feature), 6) AS share FROM counts""")
def profile_shares(spark, sf_dir):
    """Running value shares of the discrete features, as profiled."""
    discrete = _profiles(flow(spark, sf_dir)).marginals.filter("kind = 'discrete'")
    pairs = discrete.select("label", "feature", F.inline(F.arrays_zip("values", "shares")))
    return pairs.select("label", "feature", F.col("values").alias("value"), F.round("shares", 6).alias("share"))


@query(f"""WITH {FLOW}, edges AS (SELECT label, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
count(*) AS n FROM flow GROUP BY label) SELECT label, n, low, high FROM edges""")
def profile_ranges(spark, sf_dir):
    """Rows profiled per class, and the ends of a continuous feature's quantiles."""
    known = _profiles(flow(spark, sf_dir))
    ends = known.marginals.filter("feature = 'l_extendedprice'").select(
        "label", F.element_at("values", 1).alias("low"), F.element_at("values", -1).alias("high"))
    return known.correlations.select("label", "n").join(ends, "label")


@query(f"WITH {FLOW}, " + "cells AS (" + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, {'true' if c in DISCRETE else 'false'} AS candidate, {c} AS value FROM flow" for c in FEATURES)
    + f""")
SELECT label, feature, CASE WHEN candidate AND count(DISTINCT value) <= 100 THEN 'discrete' ELSE 'continuous' END AS kind,
CASE WHEN candidate AND count(DISTINCT value) <= 100 THEN count(DISTINCT value) ELSE {len(profiles.QUANTILES)} END AS n_values,
min(value) AS low, max(value) AS high FROM cells GROUP BY label, feature, candidate""")
def class_profiles(spark, sf_dir):
    """Kind, points and extremes of every class and feature."""
    return _profiles(flow(spark, sf_dir)).marginals.select(
        "label", "feature", "kind", F.size("values").cast("bigint").alias("n_values"),
        F.element_at("values", 1).alias("low"), F.element_at("values", -1).alias("high"))


@query(f"""WITH {_NEW_TRAIN}, {_QUOTA}
SELECT label, 'synthetic_old' AS origin, quota AS n FROM quota WHERE quota > 0
UNION ALL SELECT label, 'real_new', count(*) FROM new_train GROUP BY label""")
def mixed_set_counts(spark, sf_dir):
    old, train = old_flow(spark, sf_dir), _new_train(spark, sf_dir)
    baseline = fit_baseline(old, FEATURES)
    synthetic = profiles.draw(_profiles(old), balance.quota_match(train, baseline.labels))
    return balance.mix(synthetic, train, baseline).groupBy("label", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FLOW}, sized AS (SELECT label, count(*) AS n FROM flow GROUP BY label), counts AS (
SELECT label, 'real' AS origin, CASE WHEN label IN ('BENIGN', 'SQLI') THEN least(n, 15000) ELSE n END AS n FROM sized
UNION ALL SELECT label, 'synthetic', CASE WHEN label IN ('BENIGN', 'SQLI') THEN 0 ELSE greatest(0, 15000 - n) END
FROM sized) SELECT label, origin, n FROM counts WHERE n > 0""")
def balance_counts(spark, sf_dir):
    """Majority cut, minorities filled; SQLI has no profile and is cut instead."""
    rows = flow(spark, sf_dir)
    known = _profiles(rows.filter("label <> 'SQLI'"))
    return balance.balance(rows, known, keys=KEYS).groupBy("label", "origin").agg(F.count(F.lit(1)).alias("n"))
