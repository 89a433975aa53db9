import pytest
from pyspark.sql import functions as F

from conftest import rows
from flowgauge.errors import NotFitted
from flowgauge.operators import drift, state
from flowgauge.plans.baseline import fit_baseline
from flowgauge.sources import store

NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def days(spark):
    data = [(d, float(1e9 + (i * 7 + d) % 13), float(i % 5) if i % 11 else None, "ab"[i % 2] if d < 2 else "c")
            for d in range(3) for i in range(200 + d)]
    data.append((1, 1e9, 2.0, None))
    return spark.createDataFrame(data, "day int, x double, y double, label string")


@pytest.fixture(scope="module")
def parts(days):
    return [state.feature_state(days.filter(F.col("day") == d), NAMES) for d in range(3)]


def table(df, *columns, digits=9):
    return [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows(df, *columns)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_merged_parts_fit_as_all_rows(days, parts, order):
    merged = state.merge_features(state.merge_features(*[parts[i] for i in order[:2]]), parts[order[2]])
    got, want = state.baseline_of(merged), fit_baseline(days, NAMES)
    assert table(got.scaler, *want.scaler.columns) == table(want.scaler)
    assert table(got.labels) == table(want.labels) and table(got.weights) == table(want.weights)
    # A deviation of a few units around a thousand million: a mean has no digits beyond the seventh there.
    assert table(state.moments_of(merged), digits=6) == table(state.moments_of(state.feature_state(days, NAMES)), digits=6)
    direct = days.groupBy("label").agg(F.stddev_pop(F.col("x") - 1e9).alias("std"))
    assert table(state.moments_of(merged).filter("feature = 'x'"), "label", "std", digits=6) == table(direct, digits=6)


def test_wide_tables_and_empty_parts(spark):
    names = [f"f{i}" for i in range(40)]
    df = spark.createDataFrame([(*[float((r * 7 + i) % 13) for i in range(40)], "ab"[r % 2]) for r in range(50)],
                               ", ".join(f"{n} double" for n in names) + ", label string")
    empty = state.feature_state(df.filter(F.lit(False)), names)
    merged = state.merge_features(state.feature_state(df, names), empty)
    assert table(state.baseline_of(merged).scaler, "feature", "low", "high") == table(fit_baseline(df, names).scaler, "feature", "low", "high")
    with pytest.raises(NotFitted):
        state.baseline_of(empty)


def test_states_of_different_features_are_an_error(parts, days):
    with pytest.raises(ValueError, match="different features"):
        state.baseline_of(state.merge_features(parts[0], state.feature_state(days, ["y", "x"])))


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(5000).select((F.col("id") % 4).alias("part"), (F.col("id") * 37 % 997 / 997).alias("x"),
                                    (F.pow(F.col("id") * 53 % 991 / 991, 6) * 3).alias("y"))


def test_threshold_of_merged_parts(spark, points):
    fitted = drift.fit_drift(points.filter("part = 0"), NAMES, k=4, alpha=1.5, max_iter=5)
    whole = drift.fit_drift(points, NAMES, alpha=1.5, centroids=fitted.centroids)
    states = [state.distance_state(points.filter(F.col("part") == p), fitted) for p in range(4)]
    merged = state.merge_distances(*states)
    found = state.threshold_of(merged, 1.5).first()
    assert found.ci_threshold == pytest.approx(whole.ci_threshold, rel=1e-12) and found.n_rows == 5000
    beyond = round(whole.base_outlier_ratio * 5000)
    assert found.beyond_least <= beyond <= found.beyond_most and found.beyond_most - found.beyond_least < 50
    again = state.drift_of(merged, fitted)
    assert again.std == pytest.approx(whole.std) and again.base_outlier_ratio == pytest.approx(whole.base_outlier_ratio, rel=0.05)
    assert again.centroids == fitted.centroids and not again.base_was_zero
    assert merged.count() < 128 * 20
    moved = drift.fit_drift(points, NAMES, alpha=1.5, centroids=[[0.0, 0.0]])
    with pytest.raises(ValueError, match="different centres"):
        state.threshold_of(state.merge_distances(states[0], state.distance_state(points, moved)), 1.5)


def test_distances_of_zero_and_none(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (None, 1.0)], "x double, y double")
    fitted = drift.fit_drift(df, NAMES, alpha=1.0, centroids=[[0.0, 0.0]])
    again = state.drift_of(state.distance_state(df, fitted), fitted)
    assert (again.n_rows, again.base_outlier_ratio, again.base_was_zero) == (4, 0.25, False)
    assert (again.mean, again.std, again.ci_threshold) == pytest.approx((fitted.mean, fitted.std, fitted.ci_threshold))
    with pytest.raises(NotFitted):
        state.drift_of(state.distance_state(df.filter(F.lit(False)), fitted), fitted)


def test_saved_parts_are_replaced_not_added(spark, days, parts, tmp_path):
    path = str(tmp_path / "saved")
    with pytest.raises(NotFitted):
        store.load_states(spark, path, "features")
    for day in (0, 1, 2, 1):
        store.save_state(parts[day], path, "features", f"2024-01-{day:02d}")
    merged = state.merge_features(store.load_states(spark, path, "features"))
    assert table(state.baseline_of(merged).weights) == table(fit_baseline(days, NAMES).weights)
