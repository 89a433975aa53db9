"""Scores of a fixed rule that stands in for a detector."""

from pyspark.sql import functions as F

from flowgauge.operators import evaluation
from flowgauge.operators.labels import fit_labels
from flowgauge.operators.weights import class_weights
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import BOUNDARY, FLOW, flow, table

# XSS is never predicted and GHOST never occurs, so both zero rules are exercised.
_RULE = ("CASE WHEN l_extendedprice > 90000 THEN 'SQLI' WHEN l_extendedprice > 60000 THEN 'DOS' ELSE 'BENIGN' END")
_DATASET = f"CASE WHEN l_shipdate < TIMESTAMP '{BOUNDARY}' THEN 'old' ELSE 'new' END"
_SPARK_DATASET = _DATASET.replace("TIMESTAMP", "TIMESTAMP_NTZ")
_SCORED = f"{FLOW}, scored AS (SELECT label AS y, {_RULE} AS p, {_DATASET} AS dataset FROM flow)"
_KNOWN = "known AS (SELECT DISTINCT label FROM flow UNION ALL SELECT 'GHOST')"
_MATRIX = f"""{_SCORED}, {_KNOWN}, matrix AS (SELECT a.label AS y, b.label AS p, count(scored.y) AS n
FROM known a CROSS JOIN known b LEFT JOIN scored ON scored.y = a.label AND scored.p = b.label GROUP BY ALL)"""


def _report_sql(matrix="matrix", by=""):
    """CTE ``report`` from a matrix; ``by`` is a leading column list, with a comma."""
    columns = [c.strip() for c in by.split(",") if c.strip()]
    same = "".join(f" AND a.{c} = b.{c}" for c in columns)
    keep = "".join(f"a.{c}, " for c in columns)
    return f"""actual AS (SELECT {by}y AS label, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS hits
FROM {matrix} GROUP BY ALL), claimed AS (SELECT {by}p AS label, sum(n) AS claimed FROM {matrix} GROUP BY ALL),
report AS (SELECT {keep}a.label, CASE WHEN claimed = 0 THEN 0e0 ELSE hits / claimed END AS precision,
CASE WHEN support = 0 THEN 0e0 ELSE hits / support END AS recall,
CASE WHEN claimed + support = 0 THEN 0e0 ELSE 2e0 * hits / (claimed + support) END AS f1_score,
support, claimed FROM actual a JOIN claimed b ON a.label = b.label{same})"""


def _scored(spark, sf_dir):
    return flow(spark, sf_dir).select(F.col("label").alias("y"), F.expr(_RULE).alias("p"),
                                      F.expr(_SPARK_DATASET).alias("dataset"))


def _known(spark, sf_dir):
    ghost = spark.range(1).select(F.lit("GHOST").alias("label"), F.lit(4).cast("bigint").alias("idx"))
    return fit_labels(flow(spark, sf_dir)).unionByName(ghost)


def _matrix(spark, sf_dir):
    return evaluation.confusion(_scored(spark, sf_dir), _known(spark, sf_dir))


_SCORES = ["precision", "recall", "f1_score"]
_ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score"


def _rounded(df, names=_SCORES):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {_SCORED} SELECT round(100e0 * avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM scored")
def accuracy(spark, sf_dir):
    return _rounded(evaluation.accuracy(_scored(spark, sf_dir)), ["accuracy"])


@query(f"WITH {_MATRIX} SELECT y, p, n FROM matrix")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"""WITH {_MATRIX} SELECT y, CAST(sum(n) FILTER (WHERE p = 'BENIGN') AS BIGINT) AS "BENIGN",
CAST(sum(n) FILTER (WHERE p = 'DOS') AS BIGINT) AS "DOS", CAST(sum(n) FILTER (WHERE p = 'SQLI') AS BIGINT) AS "SQLI",
CAST(sum(n) FILTER (WHERE p = 'XSS') AS BIGINT) AS "XSS", CAST(sum(n) FILTER (WHERE p = 'GHOST') AS BIGINT) AS "GHOST"
FROM matrix GROUP BY y""")
def confusion_matrix_wide(spark, sf_dir):
    return evaluation.confusion_wide(_matrix(spark, sf_dir), _known(spark, sf_dir))


_REPORT_ROWS = f"SELECT label, {_ROUNDED}, CAST(support AS BIGINT) AS support FROM report"


def _report(spark, sf_dir):
    return evaluation.class_report(evaluation.pair_counts(_scored(spark, sf_dir)), labels=_known(spark, sf_dir))


@query(f"WITH {_MATRIX}, {_report_sql()} {_REPORT_ROWS}")
def class_report(spark, sf_dir):
    return _rounded(_report(spark, sf_dir).drop("claimed"))


@query(f"WITH {_MATRIX}, {_report_sql()} {_REPORT_ROWS} WHERE support > 0 OR claimed > 0")
def report_present_only(spark, sf_dir):
    present = evaluation.present_only(_report(spark, sf_dir))
    return _rounded(present.drop("claimed"))


_MEANS = f"""SELECT 'macro avg' AS label, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
round(avg(f1_score), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS support FROM report
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
CAST(sum(support) AS BIGINT) FROM report"""


@query(f"WITH {_MATRIX}, {_report_sql()} {_MEANS}")
def report_averages(spark, sf_dir):
    return _rounded(evaluation.report_averages(_report(spark, sf_dir)))


@query(f"""WITH {_SCORED}, {_KNOWN},
marked AS (SELECT dataset, y, p FROM scored UNION ALL SELECT 'hybrid', y, p FROM scored),
matrix AS (SELECT d.dataset, a.label AS y, b.label AS p, count(marked.y) AS n
FROM (SELECT DISTINCT dataset FROM marked) d CROSS JOIN known a CROSS JOIN known b
LEFT JOIN marked ON marked.dataset = d.dataset AND marked.y = a.label AND marked.p = b.label GROUP BY ALL),
{_report_sql(by='dataset, ')},
overall AS (SELECT dataset, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS share FROM matrix GROUP BY dataset)
SELECT dataset, label, {_ROUNDED}, CAST(support AS DOUBLE) AS support FROM report
UNION ALL SELECT dataset, 'accuracy', round(share, 6), round(share, 6), round(share, 6), round(share, 6) FROM overall
UNION ALL SELECT dataset, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
CAST(sum(support) AS DOUBLE) FROM report GROUP BY dataset
UNION ALL SELECT dataset, 'weighted avg', round(sum(precision * support) / sum(support), 6),
round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
CAST(sum(support) AS DOUBLE) FROM report GROUP BY dataset""")
def evaluate_by_dataset(spark, sf_dir):
    report = evaluation.evaluate(_scored(spark, sf_dir), _known(spark, sf_dir), hybrid=("old", "new"))
    return _rounded(report.drop("section"), [*_SCORES, "support"])


@query(f"""WITH matrix AS (SELECT a.v AS y, b.v AS p, count(labels.doc_id) AS n
FROM (VALUES ('0'), ('1')) a(v) CROSS JOIN (VALUES ('0'), ('1')) b(v)
LEFT JOIN labels ON CAST(quality AS VARCHAR) = a.v AND CAST(toxic AS VARCHAR) = b.v GROUP BY ALL),
{_report_sql()} {_REPORT_ROWS}""")
def binary_report(spark, sf_dir):
    """Two 0/1 annotations of the same documents, compared as truth and prediction."""
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("y"),
                                                  F.col("toxic").cast("string").alias("p"))
    known = fit_labels(pairs.select(F.col("y").alias("label")).unionByName(pairs.select(F.col("p").alias("label"))))
    return _rounded(evaluation.class_report(evaluation.pair_counts(pairs), labels=known).drop("claimed"))


# Predictions that the dictionary does not have, null ones, and truths it does not have.
_ODD = ("CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'WORM' "
        "WHEN l_extendedprice > 60000 THEN 'DOS' ELSE 'BENIGN' END")
_ODD_TRUTH = "CASE WHEN l_suppkey % 10 = 3 THEN 'NEW' ELSE label END"


@query(f"""WITH {FLOW}, scored AS (SELECT {_ODD_TRUTH} AS y, {_ODD} AS p FROM flow), known AS (SELECT DISTINCT label FROM flow),
report AS (SELECT label, (SELECT count(*) FROM scored WHERE y = label) AS support,
(SELECT count(*) FROM scored WHERE p = label) AS claimed,
(SELECT count(*) FROM scored WHERE y = label AND p = label) AS hits FROM known),
scores AS (SELECT label, CASE WHEN claimed = 0 THEN 0e0 ELSE hits / claimed END AS precision,
CASE WHEN support = 0 THEN 0e0 ELSE hits / support END AS recall,
CASE WHEN claimed + support = 0 THEN 0e0 ELSE 2e0 * hits / (claimed + support) END AS f1_score, support FROM report),
overall AS (SELECT avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END) AS share, count(*) FILTER (WHERE p IS NULL OR
y NOT IN (SELECT label FROM known) OR p NOT IN (SELECT label FROM known)) AS outside FROM scored)
SELECT label, {_ROUNDED}, CAST(support AS DOUBLE) AS support FROM scores
UNION ALL SELECT 'accuracy', round(share, 6), round(share, 6), round(share, 6), round(share, 6) FROM overall
UNION ALL SELECT 'outside', NULL, NULL, NULL, CAST(outside AS DOUBLE) FROM overall
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
CAST(sum(support) AS DOUBLE) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
CAST(sum(support) AS DOUBLE) FROM scores""")
def report_with_unknown(spark, sf_dir):
    """The report where truths and predictions leave the dictionary or are null."""
    rows = flow(spark, sf_dir)
    scored = rows.select(F.expr(_ODD_TRUTH).alias("y"), F.expr(_ODD).alias("p"))
    report = evaluation.full_report(evaluation.pair_counts(scored), labels=fit_labels(rows))
    return _rounded(report.drop("section"), [*_SCORES, "support"])


_PROBABILITY = "0.02e0 + 9e0 * l_discount + CASE WHEN l_tax > 0.05e0 THEN 0.05e0 ELSE 0e0 END"
_LOSS = f"""{FLOW}, sized AS (SELECT label, greatest(1e0, least(8.2e0, CAST((SELECT count(*) FROM flow) AS DOUBLE) /
((SELECT count(DISTINCT label) FROM flow) * count(*)))) AS weight FROM flow GROUP BY label),
losses AS (SELECT weight * pow(1 - ({_PROBABILITY}), 2) * -ln({_PROBABILITY}) AS loss
FROM flow JOIN sized ON flow.label = sized.label)"""


@query(f"WITH {_LOSS} SELECT round(avg(loss), 6) AS mean_loss, round(sum(loss), 3) AS sum_loss FROM losses")
def focal_loss(spark, sf_dir):
    rows = flow(spark, sf_dir)
    weights = class_weights(rows, fit_labels(rows)).select("label", "weight")
    scored = rows.withColumn("probability", F.expr(_PROBABILITY.replace("e0", "D"))).join(weights, "label")
    losses = evaluation.focal_rows(scored, "probability", alpha="weight", gamma=2.0)
    return losses.agg(F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(F.sum("loss"), 3).alias("sum_loss"))
