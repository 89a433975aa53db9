"""Fitted state that merges: a new day is added without reading the old days again.

A state is a small table. States of disjoint parts of the data are put together by
``merge_features`` and ``merge_distances``, in any order and grouping, and stand for all
their rows:

- the feature state, per class and feature: rows, values, range, mean and sum of squared
  deviations. Ranges, dictionary, weights and class means follow from it. Counts and ranges
  merge exactly, means and deviations up to rounding;
- the distance state, for centres that stay: the same per bin of distance, with
  ``BINS`` bins for every doubling. The threshold follows up to rounding. The rows beyond
  it are known but for those of the one bin that the threshold lies in.

Means are merged around the common mean, not by sums of squares, so that a large mean with
a small deviation loses no digits.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgauge.errors import NotFitted
from flowgauge.functions.columnwise import per_column, with_names
from flowgauge.functions.small import dense_index, settle
from flowgauge.operators.drift import ZERO_RATIO, DriftBaseline, with_distance
from flowgauge.operators.scaling import RANGE, as_doubles
from flowgauge.operators.weights import weights_of_sizes
from flowgauge.plans.baseline import Baseline
from flowgauge.sources.names import LABEL

BINS = 128          # per doubling of the distance: a bin is 0.5% wide
AT_ZERO = -1 << 20  # the bin of distance 0, below that of the least positive number

_KEPT = {"n": lambda x: F.count(F.lit(1)), "n_values": F.count, **RANGE, "mean": F.avg,
         "m2": lambda x: F.var_pop(x) * F.count(x)}


def feature_state(df, features, label=LABEL):
    """(label, ordinal, feature, n, n_values, low, high, mean, m2) of one pass over the
    rows. Null cells count in ``n`` only; a null label is a class of its own."""
    cells = per_column(df, as_doubles(features), _KEPT, by=[label])
    return with_names(cells, features, "feature").select(label, "ordinal", "feature", *_KEPT)


def merge_features(*states, label=LABEL):
    """The state of all rows of ``states``."""
    return _merged(_union(states), [label, "ordinal", "feature"])


def _union(states):
    return reduce(lambda a, b: a.unionByName(b), states)


def _merged(rows, keys):
    """One row per key. The window and the aggregate share a shuffle; a window holds one
    row per state that is merged."""
    centre = _mean("n_values", "mean", W.partitionBy(*keys))
    shifted = rows.withColumn("_m2", F.col("m2") + F.col("n_values") * F.pow(F.col("mean") - centre, 2))
    return shifted.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.min("low").alias("low"), F.max("high").alias("high"),
        _mean("n_values", "mean").alias("mean"), F.sum("_m2").alias("m2"))


def _mean(count, mean, over=None):
    total, rows = F.sum(F.col(count) * F.col(mean)), F.sum(count)
    return F.try_divide(total.over(over), rows.over(over)) if over else F.try_divide(total, rows)


def state_features(state):
    """Feature names in order. States of different features do not go together."""
    pairs = sorted((r["ordinal"], r["feature"]) for r in state.select("ordinal", "feature").distinct().collect())
    if not pairs:
        raise NotFitted("a state of no rows")
    if [ordinal for ordinal, _ in pairs] != list(range(len(pairs))):
        raise ValueError("states of different features were merged")
    return [name for _, name in pairs]


def baseline_of(state, label=LABEL):
    """Scaler, dictionary and weights, as fitted on all rows of the state."""
    state = settle(state)
    state_features(state)
    ranges = state.groupBy("feature", "ordinal").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sizes = state.filter("ordinal = 0").select(label, "n")
    labels = dense_index(sizes, label)
    return Baseline(settle(ranges), labels, weights_of_sizes(sizes, labels, label))


def moments_of(state, label=LABEL):
    """(label, feature, n_values, mean, std) with population deviations."""
    return state.select(label, "feature", "n_values", "mean", F.sqrt(F.try_divide("m2", "n_values")).alias("std"))


def centres_id(spark, drift):
    """A number that tells the centres and features of a drift baseline from others'."""
    rows = F.sum(F.xxhash64("cluster", "centroid").cast("decimal(38,0)"))
    names = F.xxhash64(F.array(*[F.lit(f) for f in drift.features]))
    return drift.centroid_table(spark).agg((F.coalesce(rows, F.lit(0)) + names).cast("string").alias("id")).first()["id"]


def distance_state(df, drift):
    """(centres, bin, n, n_values, low, high, mean, m2) of the distances of scaled rows to
    the centres of ``drift``. Rows without a distance are in the bin null."""
    distance = F.col("distance")
    place = F.when(distance > 0, F.floor(F.log2(distance) * BINS)).when(distance == 0, F.lit(AT_ZERO)).cast("bigint")
    measured = with_distance(df, drift.features, drift.centroids).select(
        F.lit(centres_id(df.sparkSession, drift)).alias("centres"), place.alias("bin"), "distance")
    return measured.groupBy("centres", "bin").agg(*[how(distance).alias(name) for name, how in _KEPT.items()])


def merge_distances(*states):
    """The state of all rows of ``states``."""
    return _merged(_union(states), ["centres", "bin"])


def threshold_of(state, alpha):
    """One row: n_rows, mean_distance, std_distance, ci_threshold, the least and the most
    rows that can lie beyond it, and their number if the threshold's bin is filled evenly."""
    if state.select("centres").distinct().limit(2).count() > 1:
        raise ValueError("distances to different centres were merged")
    whole = _merged(state, ["centres"]).select(
        F.col("n").alias("n_rows"), F.col("mean").alias("mean_distance"), F.sqrt(F.try_divide("m2", "n_values")).alias("std_distance"))
    whole = whole.withColumn("ci_threshold", F.col("mean_distance") + F.lit(float(alpha)) * F.col("std_distance"))
    low, high, ci, n = F.col("low"), F.col("high"), F.col("ci_threshold"), F.col("n_values")
    # A bin that the threshold cuts has at least one row on each side: its ends are rows.
    share = F.try_divide(high - ci, high - low)
    counts = {"beyond_least": F.when(low > ci, n).when(high > ci, F.lit(1)),
              "beyond_most": F.when(low > ci, n).when(high > ci, n - 1),
              "beyond": F.when(low > ci, n).when(high > ci, n * share)}
    names = whole.columns
    return state.join(whole).groupBy(*names).agg(
        *[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in counts.items()])


def drift_of(state, drift):
    """``drift`` with mean, deviation, threshold and base ratio of the rows of the state;
    centres, features and limits stay."""
    found = threshold_of(state, drift.alpha).first()
    if found is None:
        raise NotFitted("a drift baseline needs at least one row")
    ratio = found["beyond"] / found["n_rows"]
    return DriftBaseline(drift.features, drift.centroids, drift.alpha, found["mean_distance"], found["std_distance"],
                         found["ci_threshold"], ratio or ZERO_RATIO, ratio == 0, drift.or_threshold, found["n_rows"])
