"""Min-max scaling with fitted ranges, and feature vectors."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowgauge.errors import NotFitted
from flowgauge.functions.columnwise import per_column, with_names
from flowgauge.functions.numeric import minmax
from flowgauge.functions.small import settle
from flowgauge.operators.columns import align_features


RANGE = {"low": F.min, "high": F.max}


def as_doubles(features):
    return [F.col(f"`{c}`").cast("double") for c in features]


def fit_minmax(df, features):
    """Table (feature, ordinal, low, high): one aggregate over all features."""
    ranges = with_names(per_column(df, as_doubles(features), RANGE), features, "feature")
    return settle(ranges.select("feature", "ordinal", "low", "high"))


def fitted_ranges(scaler):
    """[(feature, low, high)] in fitted order."""
    rows = sorted(scaler.collect(), key=lambda r: r["ordinal"])
    if any(r["low"] is None for r in rows):
        raise NotFitted("the scaler was fitted on no rows")
    return [(r["feature"], r["low"], r["high"]) for r in rows]


def fitted_features(scaler):
    return [name for name, _, _ in fitted_ranges(scaler)]


def apply_minmax(df, scaler, keep=()):
    """Aligned, scaled features (values may leave [0, 1]), then ``keep``."""
    ranges = fitted_ranges(scaler)
    aligned = align_features(df, [name for name, _, _ in ranges], keep)
    return aligned.select(*[minmax(F.col(f"`{name}`").cast("double"), low, high).alias(name)
                            for name, low, high in ranges], *keep)


def assemble_features(df, features, output="features"):
    """Features in fixed order as one vector column, at single precision as trained on."""
    values = [F.col(f"`{c}`").cast("float").cast("double") for c in features]
    return df.withColumn(output, array_to_vector(F.array(*values)))
