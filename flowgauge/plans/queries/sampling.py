"""Splits, caps, undersampling."""

from pyspark.sql import functions as F

from flowgauge.operators import sampling
from flowgauge.operators.labels import fit_labels
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import FLOW, HASH_ORDER, KEY_LIST, KEYS, flow, split_sql


@query(f"WITH {FLOW}, {split_sql('flow')} SELECT {KEY_LIST}, label, split FROM split")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(flow(spark, sf_dir), keys=KEYS).select(*KEYS, "label", "split")


_NUMBERED = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_ORDER}) AS rn FROM flow)"


@query(f"WITH {FLOW}, {_NUMBERED} SELECT {KEY_LIST}, label FROM numbered WHERE rn <= 5000")
def class_cap(spark, sf_dir):
    return sampling.cap_classes(flow(spark, sf_dir), cap=5000, keys=KEYS).select(*KEYS, "label")


@query(f"""WITH {FLOW}, known AS (SELECT DISTINCT label FROM flow UNION ALL SELECT 'GHOST'),
sized AS (SELECT known.label, count(flow.label) AS n FROM known LEFT JOIN flow ON known.label = flow.label
GROUP BY known.label)
SELECT label, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 1190 THEN 'few' ELSE 'ok' END AS state FROM sized""")
def small_classes(spark, sf_dir):
    rows = flow(spark, sf_dir)
    known = fit_labels(rows).select("label").unionByName(spark.range(1).select(F.lit("GHOST").alias("label")))
    return sampling.small_classes(rows, known, least=1190)


@query(f"WITH {FLOW}, {_NUMBERED} SELECT {KEY_LIST}, label FROM numbered WHERE label <> 'BENIGN' OR rn <= 15000")
def undersample(spark, sf_dir):
    return sampling.undersample(flow(spark, sf_dir), keys=KEYS).select(*KEYS, "label")


@query(f"WITH {FLOW} SELECT {KEY_LIST}, label FROM flow")
def shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(flow(spark, sf_dir).select(*KEYS, "label"), KEYS)
