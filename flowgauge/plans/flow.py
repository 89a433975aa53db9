"""The flow table the queries run on: line items with a derived, imbalanced label.

The SQL fragments state the same tables for the second engine.
"""

from pyspark.sql import functions as F

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ALPHA = 1.5
BOUNDARY = "1999-01-01"

LABEL_SQL = ("CASE WHEN l_quantity <= 40 THEN 'BENIGN' WHEN l_quantity <= 48 THEN 'DOS' "
             "WHEN l_quantity = 49 THEN 'XSS' ELSE 'SQLI' END")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("label", F.expr(LABEL_SQL))


def is_old():
    return F.col("l_shipdate") < F.lit(BOUNDARY).cast("timestamp_ntz")


def old_flow(spark, sf_dir):
    return flow(spark, sf_dir).filter(is_old())


def new_flow(spark, sf_dir, price_factor=1.0):
    rows = flow(spark, sf_dir).filter(~is_old())
    if price_factor == 1.0:
        return rows
    return rows.withColumn("l_extendedprice", F.col("l_extendedprice") * F.lit(price_factor))


DIRTY = {
    "bytes_s": ("CASE WHEN l_linenumber = 7 THEN CAST('Infinity' AS DOUBLE) "
                "WHEN l_linenumber = 6 THEN CAST('NaN' AS DOUBLE) "
                "WHEN l_linenumber = 5 THEN NULL "
                "WHEN l_linenumber = 4 THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END"),
    "packets": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END",
    "urg_flags": "CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(0 AS DOUBLE) END",
    "idle": "CAST(3 AS DOUBLE)",
}


def dirty_flow(spark, sf_dir):
    return flow(spark, sf_dir).select(*KEYS, *[F.expr(sql).alias(c) for c, sql in DIRTY.items()], "label")


# --- the same tables in SQL ---

FLOW = f"flow AS (SELECT *, {LABEL_SQL} AS label FROM lineitem)"
OLD = f"{FLOW}, old AS (SELECT * FROM flow WHERE l_shipdate < TIMESTAMP '{BOUNDARY}')"
OLD_NEW = f"{OLD}, new AS (SELECT * FROM flow WHERE l_shipdate >= TIMESTAMP '{BOUNDARY}')"
DIRTY_FLOW = (f"{FLOW}, dirty AS (SELECT {', '.join(KEYS)}, "
              + ", ".join(f"{sql} AS {c}" for c, sql in DIRTY.items()) + ", label FROM flow)")
KEY_LIST = ", ".join(KEYS)
ORDER_KEY = f"md5(concat_ws('|', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in KEYS)}))"
# Rows equal in the hashed columns are told apart by the rest of the row.
HASH_ORDER = (f"{ORDER_KEY}, {KEY_LIST}, l_quantity, l_extendedprice, l_discount, l_tax, "
              "l_returnflag, l_linestatus, l_shipdate")


def split_sql(source, name="split"):
    """``source`` with a column split, as the stratified split assigns it."""
    return (f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH_ORDER}) AS rn, "
            f"count(*) OVER (PARTITION BY label) AS cn FROM {source}), "
            f"{name} AS (SELECT * EXCLUDE (rn, cn), CASE WHEN cn > 1 AND rn <= ceil(0.3e0 * cn) THEN 'test' "
            f"ELSE 'train' END AS split FROM {name}_n)")


def scaled_sql(source, target, ranges="ranges", price_factor=None):
    """``source`` min-max scaled as columns q, e, d, t beside its own columns."""
    def one(column, short):
        value = f"{column} * {price_factor}" if price_factor and column == "l_extendedprice" else column
        return (f"({value} - {short}_lo) / coalesce(nullif({short}_hi - {short}_lo, 0), 1) AS {short}")
    parts = ", ".join(one(c, s) for c, s in SHORT.items())
    return f"{target} AS (SELECT {source}.*, {parts} FROM {source}, {ranges})"


SHORT = dict(zip(FEATURES, "qedt"))
RANGES = "ranges AS (SELECT " + ", ".join(
    f"min({c}) AS {s}_lo, max({c}) AS {s}_hi" for c, s in SHORT.items()) + " FROM old)"
CENTROIDS = "centroids AS (SELECT label AS c_label, " + ", ".join(
    f"avg({s}) AS c{s}" for s in SHORT.values()) + " FROM old_s GROUP BY label)"


def distance_sql(source, target):
    squares = " + ".join(f"({source}.{s} - c{s}) * ({source}.{s} - c{s})" for s in SHORT.values())
    return (f"{target} AS (SELECT {source}.*, (SELECT min(sqrt({squares})) FROM centroids) AS distance "
            f"FROM {source})")


DRIFT = ", ".join([
    OLD_NEW, RANGES, scaled_sql("old", "old_s"), scaled_sql("new", "new_s", price_factor="1.5e0"), CENTROIDS,
    distance_sql("old_s", "old_d"), distance_sql("new_s", "new_d"),
    f"fit AS (SELECT count(*) AS n_rows, avg(distance) AS mean_distance, stddev_pop(distance) AS std_distance, "
    f"avg(distance) + {ALPHA}e0 * stddev_pop(distance) AS ci FROM old_d)",
    "base AS (SELECT avg(CASE WHEN distance > ci THEN 1e0 ELSE 0e0 END) AS ratio FROM old_d, fit)",
    "fresh AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE distance > ci) AS n_outliers, "
    "avg(CASE WHEN distance > ci THEN 1e0 ELSE 0e0 END) AS ratio FROM new_d, fit)",
])
