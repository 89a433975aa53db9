from conftest import rows
from flowgauge.operators import cleaning

INF, NAN = float("inf"), float("nan")
DIRTY = [(1.0, 0.0, 3.0, 1, "a"), (INF, 0.0, 3.0, None, "b"), (-INF, None, 3.0, 0, None), (NAN, 0.0, 3.0, 2, "c")]
SCHEMA = "x double, zero double, const double, n int, label string"


def test_profile_counts_each_kind(spark):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    assert rows(cleaning.quality_profile(df)) == [("const", 0, 0), ("n", 1, 0), ("x", 1, 2), ("zero", 1, 0)]
    assert cleaning.has_dirty_values(df)


def test_clean_values_and_types(spark):
    df = cleaning.clean_values(spark.createDataFrame(DIRTY, SCHEMA))
    assert df.dtypes == [("x", "double"), ("zero", "double"), ("const", "double"), ("n", "int"), ("label", "string")]
    assert [tuple(r) for r in df.collect()] == [(1.0, 0.0, 3.0, 1, "a"), (0.0, 0.0, 3.0, 0, "b"),
                                                (0.0, 0.0, 3.0, 0, None), (0.0, 0.0, 3.0, 2, "c")]
    assert not cleaning.has_dirty_values(df)


def test_zero_columns_need_clean_values(spark):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    assert cleaning.zero_columns(df) == []
    cleaned = cleaning.clean_values(df)
    assert cleaning.zero_columns(cleaned) == ["zero"]
    assert cleaning.drop_zero_columns(cleaned).columns == ["x", "const", "n", "label"]
    assert cleaning.zero_columns(cleaned, keep=["zero"]) == []


def test_wide_tables_take_the_other_path_to_the_same_result(spark):
    width = 120
    data = [tuple(float(i % 7) if i % 3 else (INF if r else NAN) for i in range(width)) for r in range(2)]
    df = spark.createDataFrame(data, ", ".join(f"f{i} double" for i in range(width)))
    profile = {r.column_name: (r.n_missing, r.n_infinite) for r in cleaning.quality_profile(df).collect()}
    assert profile == {f"f{i}": (0, 0) if i % 3 else (1, 1) for i in range(width)}
    zero = cleaning.zero_columns(cleaning.clean_values(df))
    assert zero == [f"f{i}" for i in range(width) if i % 3 == 0 or i % 7 == 0]


def test_column_names_with_odd_characters(spark):
    df = spark.createDataFrame([(0.0, INF)], "`a/s` double, `b.1` double")
    assert rows(cleaning.clean_values(df)) == [(0.0, 0.0)]
    assert cleaning.zero_columns(cleaning.clean_values(df)) == ["a/s", "b.1"]
