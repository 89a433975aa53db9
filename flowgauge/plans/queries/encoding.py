"""Dictionary, scaling, weights."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowgauge.operators import labels, scaling, weights
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import (FEATURES, FLOW, KEY_LIST, KEYS, OLD, OLD_NEW, RANGES, SHORT, flow, new_flow,
                                  old_flow, scaled_sql)

_DICTIONARY = ("dictionary AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx "
               "FROM (SELECT DISTINCT label FROM flow))")


@query(f"WITH {FLOW}, {_DICTIONARY} SELECT label, CAST(idx AS BIGINT) AS idx FROM dictionary")
def label_dictionary(spark, sf_dir):
    return labels.fit_labels(flow(spark, sf_dir))


@query(f"""WITH {FLOW}, {_DICTIONARY} SELECT {KEY_LIST}, flow.label, CAST(idx AS BIGINT) AS idx
FROM flow JOIN dictionary ON flow.label = dictionary.label""")
def encode_labels(spark, sf_dir):
    rows = flow(spark, sf_dir)
    return labels.encode_labels(rows.select(*KEYS, "label"), labels.fit_labels(rows))


@query(f"WITH {OLD} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS ordinal, min({c}) AS low, max({c}) AS high FROM old"
    for i, c in enumerate(FEATURES)))
def minmax_fit(spark, sf_dir):
    return scaling.fit_minmax(old_flow(spark, sf_dir), FEATURES)


@query(f"WITH {OLD_NEW}, {RANGES}, {scaled_sql('new', 'new_s')} SELECT {KEY_LIST}, "
       + ", ".join(f"round({s}, 6) AS {c}" for c, s in SHORT.items()) + " FROM new_s")
def minmax_apply(spark, sf_dir):
    scaler = scaling.fit_minmax(old_flow(spark, sf_dir), FEATURES)
    scaled = scaling.apply_minmax(new_flow(spark, sf_dir), scaler, KEYS)
    return scaled.select(*KEYS, *[F.round(c, 6).alias(c) for c in FEATURES])


@query(f"""WITH {FLOW} SELECT {KEY_LIST}, unnest(generate_series(0, 3)) AS ordinal,
round(CAST(CAST(unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS FLOAT) AS DOUBLE), 4) AS value FROM flow""")
def assemble_features(spark, sf_dir):
    vectors = scaling.assemble_features(flow(spark, sf_dir), FEATURES)
    cells = vectors.select(*KEYS, F.posexplode(vector_to_array("features")).alias("ordinal", "value"))
    return cells.select(*KEYS, F.col("ordinal").cast("bigint").alias("ordinal"), F.round("value", 4).alias("value"))


def _with_ghost(spark, rows):
    known = labels.fit_labels(rows)
    return known.unionByName(spark.range(1).select(F.lit("GHOST").alias("label"), F.lit(4).cast("bigint").alias("idx")))


_GHOST = f"""{FLOW}, {_DICTIONARY}, known AS (SELECT * FROM dictionary UNION ALL SELECT 'GHOST', 4),
sized AS (SELECT known.label, CAST(idx AS BIGINT) AS idx, greatest(count(flow.label), 1) AS n
FROM known LEFT JOIN flow ON known.label = flow.label GROUP BY ALL)"""


@query(f"WITH {_GHOST} SELECT label, idx, n FROM sized")
def class_counts(spark, sf_dir):
    rows = flow(spark, sf_dir)
    return weights.class_counts(rows, _with_ghost(spark, rows))


_WEIGHTS = f"""{_GHOST}, weighted AS (SELECT label, idx, n, round(greatest(1e0, least(8.2e0,
CAST((SELECT count(*) FROM flow) AS DOUBLE) / ((SELECT count(*) FROM known) * n))), 6) AS weight FROM sized)"""


@query(f"WITH {_WEIGHTS} SELECT * FROM weighted")
def class_weights(spark, sf_dir):
    rows = flow(spark, sf_dir)
    return weights.class_weights(rows, _with_ghost(spark, rows)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_WEIGHTS} SELECT * FROM weighted WHERE label = 'DOS'")
def class_weight_of(spark, sf_dir):
    return weights.weight_of(class_weights(spark, sf_dir), "DOS")
