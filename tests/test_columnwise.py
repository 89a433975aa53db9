import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from flowgauge import session as sessions
from flowgauge.errors import NotFitted
from flowgauge.functions.columnwise import WIDE_LIMIT
from flowgauge.functions.distance import EXPRESSION_TERMS, nearest_distance
from flowgauge.functions.running import running_totals
from flowgauge.operators import cleaning, drift, scaling


@pytest.mark.parametrize("width", [4, 58])
def test_an_empty_table_has_a_row_per_column(spark, width):
    names = [f"f{i}" for i in range(width)]
    assert (2 * width > WIDE_LIMIT) == (width == 58)
    empty = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    assert rows(cleaning.quality_profile(empty)) == sorted((n, 0, 0) for n in names)
    assert cleaning.zero_columns(empty) == names
    scaler = scaling.fit_minmax(empty, names)
    assert scaler.count() == width
    with pytest.raises(NotFitted):
        scaling.apply_minmax(empty, scaler)


@pytest.mark.parametrize("points", [2, 60, 700])
def test_distance_is_the_same_for_few_and_many_points(spark, points):
    assert (2 * points <= EXPRESSION_TERMS) == (points == 2)
    data = [(0, 0.0, 0.0), (1, float("nan"), 0.0), (2, None, 1.0), (3, float("inf"), 1.0), (4, 3.0, 4.0), (5, float("-inf"), float("nan"))]
    df = spark.createDataFrame(data, "k int, a double, b double")
    centres = [[0.0, 0.0]] + [[100.0 + i, 0.0] for i in range(points - 1)]
    found = {r.k: r.d for r in df.select("k", nearest_distance(["a", "b"], centres).alias("d")).collect()}
    assert found == {0: 0.0, 1: None, 2: None, 3: math.inf, 4: 5.0, 5: None}
    measured = drift.outlier_ratio(df.select(nearest_distance(["a", "b"], centres).alias("distance")), 6.0).first()
    assert tuple(measured) == (6, 1, 1 / 6)


def test_ranges_and_means_in_one_pass(spark):
    df = spark.createDataFrame([(float(i), 5.0, "ab"[i % 2]) for i in range(11)], "x double, c double, label string")
    scaler, centroids = drift.ranges_and_class_means(df, ["x", "c"], "label")
    again = scaling.fit_minmax(df, ["x", "c"])
    assert rows(scaler) == rows(again)
    assert centroids == drift.class_means(scaling.apply_minmax(df, again, ["label"]), ["x", "c"], "label")


def test_running_totals_of_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("k"), "id", F.lit(2).alias("v"))
    found = running_totals(df, ["k"], ["id"], "v", "before").collect()
    seen = {}
    for r in sorted(found, key=lambda r: (r.k, r.id)):
        assert r.before == seen.get(r.k, 0)
        seen[r.k] = r.before + 2
    assert len(found) == 2000
    assert running_totals(df.filter("id < 0"), [], ["id"], "v", "before").count() == 0


def test_a_cluster_has_to_name_its_shared_folder(spark):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        sessions.shared_folder(Session())
