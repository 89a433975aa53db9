import pytest
from pyspark.ml.functions import vector_to_array

from conftest import rows
from flowgauge.errors import MissingFeatures, NotFitted
from flowgauge.operators import labels, scaling, weights


def test_minmax_is_not_clipped_and_constant_divides_by_one(spark):
    old = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, c double")
    scaler = scaling.fit_minmax(old, ["a", "c"])
    new = spark.createDataFrame([(7.0, -5.0), (5.0, 20.0)], "c double, a double")
    assert rows(scaling.apply_minmax(new, scaler)) == [(-0.5, 2.0), (2.0, 0.0)]
    with pytest.raises(MissingFeatures):
        scaling.apply_minmax(new.drop("c"), scaler)


def test_scaler_on_no_rows(spark):
    with pytest.raises(NotFitted):
        scaling.fitted_ranges(scaling.fit_minmax(spark.createDataFrame([], "a double"), ["a"]))


def test_training_rows_lie_in_unit_range(spark):
    names = [f"f{i}" for i in range(90)]
    data = [tuple(float((r * 31 + i * 17) % 23) for i in range(90)) for r in range(40)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    scaler = scaling.fit_minmax(df, names)
    assert scaling.fitted_features(scaler) == names
    low = min(min(r) for r in scaling.apply_minmax(df, scaler).collect())
    high = max(max(r) for r in scaling.apply_minmax(df, scaler).collect())
    assert (low, high) == (0.0, 1.0)


def test_vectors_keep_order(spark):
    df = scaling.assemble_features(spark.createDataFrame([(1.5, 2.5)], "b double, a double"), ["a", "b"])
    assert df.select(vector_to_array("features")).first()[0] == [2.5, 1.5]


def test_weights_are_clipped(spark):
    data = [("BENIGN",)] * 160 + [("DOS",)] * 32 + [("XSS",)] * 2
    df = spark.createDataFrame(data, "label string")
    known = labels.fit_labels(df).unionByName(spark.createDataFrame([("ZERO", 3)], "label string, idx bigint"))
    got = {r.label: (r.n, round(r.weight, 4)) for r in weights.class_weights(df, known).collect()}
    assert got == {"BENIGN": (160, 1.0), "DOS": (32, round(194 / 128, 4)), "XSS": (2, 8.2), "ZERO": (1, 8.2)}
    assert rows(weights.class_counts(df, known), "label", "n")[-1] == ("ZERO", 1)
    assert weights.weight_of(weights.class_weights(df, known)).count() == 1
    assert weights.weight_of(weights.class_weights(df, known), "ABSENT").count() == 0
