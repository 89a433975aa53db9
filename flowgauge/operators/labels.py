"""Label values: census, mapping, dictionary, membership, encoding."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.errors import NoKnownLabels
from flowgauge.functions.small import dense_index
from flowgauge.sources.names import LABEL, LABEL_ALIASES, NORMAL


def label_census(df, label=LABEL):
    """Rows per raw label, largest first."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.col(label)))


def zero_to_normal(df, label=LABEL, normal=NORMAL):
    """The label 0, as number or text, becomes ``normal``; the column becomes text."""
    column = F.col(label)
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    zero = column == 0 if numeric else column == "0"
    return df.withColumn(label, F.when(zero, F.lit(normal)).otherwise(column.cast("string")))


def upper_label(df, label=LABEL):
    """Upper-case text; a null label becomes the class ``NAN``."""
    return df.withColumn(label, F.upper(F.coalesce(F.col(label).cast("string"), F.lit("NAN"))))


def map_labels(df, mapping=None, label=LABEL):
    """Replace the label values that are keys of ``mapping``."""
    return df.replace(LABEL_ALIASES if mapping is None else mapping, subset=[label])


def rows_of_label(df, value, label=LABEL):
    return df.filter(F.col(label) == value)


def fit_labels(df, label=LABEL):
    """Dictionary (label, idx): sorted distinct labels numbered from 0."""
    return dense_index(df.select(label).distinct(), label)


def encode_labels(df, labels, label=LABEL, index="idx"):
    """Attach the dictionary index; a label outside the dictionary fails the query."""
    coded = df.join(labels.select(label, F.col("idx").alias("_idx")), label, "left")
    message = F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))
    checked = F.when(F.col("_idx").isNull(), F.raise_error(message)).otherwise(F.col("_idx"))
    return coded.select(*[f"`{c}`" for c in df.columns], checked.cast("bigint").alias(index))


def keep_known_labels(df, labels, label=LABEL):
    """Rows whose label is in the dictionary."""
    return df.join(labels.select(label), label, "left_semi").select(*[f"`{c}`" for c in df.columns])


def retention(df, labels, label=LABEL):
    """One row: all rows, rows with a known label, and their share."""
    flagged = df.select(label).join(labels.select(label, F.lit(True).alias("_known")), label, "left")
    return (flagged.agg(F.count(F.lit(1)).alias("n_all"), F.count("_known").alias("n_kept"))
            .withColumn("kept_share", F.coalesce(F.try_divide(F.col("n_kept"), F.col("n_all")), F.lit(0.0))))


def require_known_labels(df, labels, label=LABEL):
    """Keep the known rows; an empty result is an error, found at the first known row."""
    kept = keep_known_labels(df, labels, label)
    if kept.select(label).isEmpty():
        raise NoKnownLabels("no row has a label of the fitted dictionary")
    return kept
