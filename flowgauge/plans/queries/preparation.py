"""Sources, names, projections, cleaning, labels."""

from pyspark.sql import functions as F

from flowgauge.operators import cleaning, columns, labels
from flowgauge.plans.catalog import query
from flowgauge.plans.flow import (DIRTY, DIRTY_FLOW, FEATURES, FLOW, KEY_LIST, KEYS, OLD, OLD_NEW, dirty_flow,
                                  flow, new_flow, old_flow, table)
from flowgauge.sources.names import COLUMN_MAP
from flowgauge.sources.relabel import relabel_sources as relabel


@query(f"WITH {FLOW} SELECT label, count(*) AS n FROM flow GROUP BY label")
def label_census(spark, sf_dir):
    return labels.label_census(flow(spark, sf_dir))


SOURCE_MAP = {"click": "hydra", "error": "nikto", "purchase": "nmap", "view": "sqli"}


@query("""
SELECT event_id, event_type AS source,
       CASE WHEN value <= 50 THEN 'normal'
            WHEN event_type = 'click' THEN 'hydra' WHEN event_type = 'error' THEN 'nikto'
            WHEN event_type = 'purchase' THEN 'nmap' WHEN event_type = 'view' THEN 'sqli'
            ELSE '1' END AS label
FROM events""")
def relabel_sources(spark, sf_dir):
    binary = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("source"), F.when(F.col("value") > 50, 1).otherwise(0).alias("label"))
    return relabel(binary, "source", SOURCE_MAP)


def _raw_headers(spark, sf_dir):
    """Line items under the padded, repeated and mixed-case names of a flow export."""
    rows = flow(spark, sf_dir)
    raw = {"Flow ID": "l_orderkey", " Flow Duration": "l_extendedprice", "Flow Bytes/s": "l_tax",
           "Fwd Header Length ": "l_quantity", " Fwd Header Length.1": "l_discount",
           "Tot Fwd Pkts": "l_suppkey", "Extra Column": "l_partkey", " Label": "label"}
    return rows.select(*[F.col(c).alias(name) for name, c in raw.items()])


@query(f"""WITH {FLOW} SELECT l_orderkey AS flow_id, l_extendedprice AS flow_duration, l_tax AS "flow_bytes/s",
l_quantity AS fwd_header_length, l_suppkey AS tot_fwd_pkts, l_partkey AS extra_column, label FROM flow""")
def standardize_columns(spark, sf_dir):
    return columns.standardize_columns(_raw_headers(spark, sf_dir))


@query(f"""WITH {FLOW} SELECT l_orderkey AS "flow id", l_extendedprice AS "flow duration", l_tax AS "flow bytes/s",
l_quantity AS "fwd header length", l_suppkey AS "tot fwd pkts", l_partkey AS "extra column", label FROM flow""")
def clean_names(spark, sf_dir):
    return columns.clean_names(_raw_headers(spark, sf_dir))


@query("SELECT l_quantity AS packets, l_tax AS bytes, l_orderkey AS flow_id FROM lineitem")
def dedupe_columns(spark, sf_dir):
    repeated = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("packets"), F.col("l_tax").alias("bytes"),
        F.col("l_discount").alias("packets"), F.col("l_orderkey").alias("flow_id"), F.col("l_suppkey").alias("bytes"))
    return columns.drop_duplicate_columns(repeated)


@query(f"""WITH {FLOW} SELECT l_orderkey AS flow_id, l_extendedprice AS flow_duration, l_tax AS flow_byts_s,
l_quantity AS fwd_header_len, l_suppkey AS tot_fwd_pkts, l_partkey AS "extra column", label FROM flow""")
def rename_by_map(spark, sf_dir):
    return columns.standardize_columns(_raw_headers(spark, sf_dir), COLUMN_MAP)


@query(f"WITH {FLOW} SELECT l_tax, l_quantity, label FROM flow")
def project_whitelist(spark, sf_dir):
    return columns.project_features(flow(spark, sf_dir), ["l_tax", "absent_feature", "l_quantity"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_numeric(spark, sf_dir):
    return columns.select_numeric(table(spark, sf_dir, "lineitem"))


@query(f"WITH {FLOW} SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM flow")
def feature_label_split(spark, sf_dir):
    features, _ = columns.split_label(flow(spark, sf_dir).select("l_orderkey", *FEATURES, "label"))
    return features


@query(f"WITH {FLOW} SELECT l_quantity, l_extendedprice, l_discount, l_tax, label FROM flow")
def align_features(spark, sf_dir):
    shuffled = flow(spark, sf_dir).select("l_tax", "label", "l_suppkey", "l_discount", "l_quantity", "l_extendedprice")
    return columns.align_features(shuffled, FEATURES, ["label"])


_PROFILED = [*KEYS, *DIRTY]


@query(f"WITH {DIRTY_FLOW} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS n_missing, "
    f"count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n_infinite FROM dirty" for c in _PROFILED))
def quality_profile(spark, sf_dir):
    return cleaning.quality_profile(dirty_flow(spark, sf_dir))


_CLEANED = ", ".join([
    KEY_LIST, "CASE WHEN bytes_s IS NULL OR isnan(bytes_s) OR isinf(bytes_s) THEN 0e0 ELSE bytes_s END AS bytes_s",
    "coalesce(packets, 0) AS packets"])


@query(f"WITH {DIRTY_FLOW} SELECT {_CLEANED}, coalesce(urg_flags, 0e0) AS urg_flags, idle, label FROM dirty")
def clean_values(spark, sf_dir):
    return cleaning.clean_values(dirty_flow(spark, sf_dir))


@query(f"WITH {DIRTY_FLOW} SELECT {_CLEANED}, idle, label FROM dirty")
def drop_zero_columns(spark, sf_dir):
    return cleaning.drop_zero_columns(cleaning.clean_values(dirty_flow(spark, sf_dir)))


@query("""SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'normal' ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS label
FROM lineitem""")
def zero_label_to_normal(spark, sf_dir):
    numbered = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("label"))
    return labels.zero_to_normal(numbered)


def _odd_labels(spark, sf_dir):
    return flow(spark, sf_dir).select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.lower("label")).alias("label"))


@query(f"WITH {FLOW} SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'NAN' ELSE label END AS label FROM flow")
def upper_label(spark, sf_dir):
    return labels.upper_label(_odd_labels(spark, sf_dir))


@query(f"""WITH {FLOW} SELECT l_orderkey, CASE label WHEN 'XSS' THEN 'FTP-PATATOR' WHEN 'SQLI' THEN 'SSH-PATATOR'
ELSE label END AS label FROM flow""")
def label_aliases(spark, sf_dir):
    spelled = labels.map_labels(flow(spark, sf_dir).select("l_orderkey", "label"),
                                {"XSS": "FTP-BRUTEFORCE", "SQLI": "SSH-BRUTEFORCE"})
    return labels.map_labels(spelled)


_NEW_BOT = "CASE WHEN l_linenumber = 7 THEN 'BOT' ELSE label END"


def _new_with_unknown(spark, sf_dir):
    return new_flow(spark, sf_dir).select(*KEYS, F.expr(_NEW_BOT).alias("label"))


@query(f"""WITH {OLD_NEW} SELECT * FROM (SELECT {KEY_LIST}, {_NEW_BOT} AS label FROM new)
WHERE label IN (SELECT label FROM old)""")
def known_label_filter(spark, sf_dir):
    return labels.require_known_labels(_new_with_unknown(spark, sf_dir), labels.fit_labels(old_flow(spark, sf_dir)))


@query(f"""WITH {OLD_NEW}, relabelled AS (SELECT {_NEW_BOT} AS label FROM new)
SELECT count(*) AS n_all, count(*) FILTER (WHERE label IN (SELECT label FROM old)) AS n_kept,
round(count(*) FILTER (WHERE label IN (SELECT label FROM old)) / count(*), 6) AS kept_share FROM relabelled""")
def retention(spark, sf_dir):
    kept = labels.retention(_new_with_unknown(spark, sf_dir), labels.fit_labels(old_flow(spark, sf_dir)))
    return kept.withColumn("kept_share", F.round("kept_share", 6))


@query(f"WITH {FLOW} SELECT {KEY_LIST}, label FROM flow WHERE label = 'XSS'")
def rows_of_label(spark, sf_dir):
    return labels.rows_of_label(flow(spark, sf_dir), "XSS").select(*KEYS, "label")
