"""Arithmetic on columns: finiteness, scaling, loss."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST_DOUBLE = 1.7976931348623157e308
SMALLEST_NORMAL_DOUBLE = 2.2250738585072014e-308


def numeric_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_fractional(data_type):
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_finite(name):
    """False or null for NaN, infinity and null: Spark orders NaN above every number."""
    return F.abs(F.col(f"`{name}`").cast("double")) <= F.lit(LARGEST_DOUBLE)


def finite_or_zero(field):
    """The column with null, NaN and infinity replaced by 0, in its own type."""
    column = F.col(f"`{field.name}`")
    zero = F.lit(0).cast(field.dataType)
    if is_fractional(field.dataType):
        return F.when(is_finite(field.name), column).otherwise(zero)
    return F.coalesce(column, zero)


def minmax(column, low, high):
    """Scale by a fitted range without clipping; a constant feature divides by 1."""
    width = high - low
    return (column - F.lit(low)) / F.lit(width if width else 1.0)


def outlier_share(outlier):
    return F.avg(F.when(outlier, 1.0).otherwise(0.0))


def focal(probability, alpha=None, gamma=0.0):
    """Row loss ``alpha * (1 - p)^gamma * -ln p``; gamma 0 is cross-entropy.

    ``p`` is floored at the smallest normal double, since ``ln(0)`` is null in
    Spark and a null row would silently leave the mean.
    """
    floored = F.greatest(probability, F.lit(SMALLEST_NORMAL_DOUBLE))
    loss = -F.log(floored)
    if gamma:
        loss = F.pow(F.lit(1.0) - probability, F.lit(float(gamma))) * loss
    if alpha is not None:
        loss = alpha * loss
    return loss


def log_probability(scores, index):
    """Log of the softmax of an array of raw scores at a position, without underflow."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.element_at(scores, index.cast("int") + 1) - top - F.log(total)
