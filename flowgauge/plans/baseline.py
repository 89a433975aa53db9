"""Fit preparation parameters on old data and apply them to any later data."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.errors import NoFeatures
from flowgauge.functions.columnwise import per_column, with_names
from flowgauge.functions.hashing import SEED
from flowgauge.functions.small import dense_index, settle
from flowgauge.operators.cleaning import clean_values, drop_zero_columns
from flowgauge.operators.columns import (align_features, project_features, require_label,
                                         standardize_columns)
from flowgauge.operators.labels import (encode_labels, map_labels, require_known_labels,
                                        upper_label, zero_to_normal)
from flowgauge.operators.sampling import TEST_SHARE, stratified_split
from flowgauge.operators.scaling import RANGE, apply_minmax, as_doubles, fitted_features
from flowgauge.operators.weights import weights_of_sizes
from flowgauge.sources.names import LABEL


@dataclass
class Baseline:
    """Fitted tables: scaler (feature, ordinal, low, high), labels (label, idx),
    weights (label, idx, n, weight)."""

    scaler: DataFrame
    labels: DataFrame
    weights: DataFrame

    @property
    def features(self):
        return fitted_features(self.scaler)


def prepare_old(df, label=LABEL, rename_map=None, whitelist=None, zero_is_normal=True):
    """Names, values and labels of old data; columns of nothing but 0 are dropped."""
    df = clean_values(standardize_columns(df, rename_map))
    require_label(df, label)
    # A label of nothing but the number 0 is one class, not an empty feature.
    df = drop_zero_columns(df, keep=[label])
    if whitelist:
        df = project_features(df, whitelist, label)
    if zero_is_normal:
        df = zero_to_normal(df, label)
    return upper_label(df, label)


def prepare_new(df, label=LABEL, rename_map=None, zero_is_normal=True, aliases=None):
    """As for old data, but every column stays: a fitted feature may be 0 here."""
    df = clean_values(standardize_columns(df, rename_map))
    require_label(df, label)
    if zero_is_normal:
        df = zero_to_normal(df, label)
    return map_labels(upper_label(df, label), aliases, label)


def fit_baseline(train, features, label=LABEL):
    """Scaler, dictionary and weights from one pass over the training part.

    The pass gives size and feature ranges per class; all three tables follow from
    its labels times features rows.
    """
    require_label(train, label)
    if not features:
        raise NoFeatures("no feature to fit")
    stats = settle(per_column(train, as_doubles(features), {"n": _rows, **RANGE}, by=[label]))
    ranges = stats.groupBy("ordinal").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ranges = with_names(ranges, features, "feature").select("feature", "ordinal", "low", "high")
    sizes = stats.filter("ordinal = 0").select(label, "n")
    labels = dense_index(sizes, label)
    return Baseline(settle(ranges), labels, weights_of_sizes(sizes, labels, label))


def _rows(column):
    return F.count(F.lit(1))


def fit_on_split(df, label=LABEL, keys=None, share=TEST_SHARE, seed=SEED):
    """(train, test, baseline): the usual start, from prepared old data."""
    require_label(df, label)
    features = [c for c in df.columns if c != label and c not in (keys or [])]
    split = stratified_split(df, label, share, keys, seed)
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    return train, test, fit_baseline(train, features, label)


def apply_baseline(df, baseline, label=LABEL, scale=True, keep=()):
    """Known rows, fitted features in order, scaled unless told otherwise, with ``idx``."""
    require_label(df, label)
    known = require_known_labels(df, baseline.labels, label)
    kept = [label, *keep]
    if scale:
        shaped = apply_minmax(known, baseline.scaler, kept)
    else:
        shaped = align_features(known, baseline.features, kept)
    return encode_labels(shaped, baseline.labels, label)
