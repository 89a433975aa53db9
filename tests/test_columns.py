import pytest

from conftest import rows
from flowgauge.errors import NameCollision, MissingFeatures, MissingLabel, NoFeatures
from flowgauge.operators import columns
from flowgauge.sources.names import (COLUMN_MAP, feature_kinds, CONTINUOUS_FEATURES, DISCRETE_FEATURES, FEATURES, TIME_FEATURES,
                                     feature_table)

HEADERS_2017 = [" Flow Duration", "Total Length of Fwd Packets", " Fwd Header Length", " Fwd Header Length.1",
                "min_seg_size_forward", "Flow Bytes/s", " Label"]
HEADERS_2018 = ["Flow Duration", "TotLen Fwd Pkts", "Fwd Header Len", "Fwd Header Len.1",
                "Fwd Seg Size Min", "Flow Byts/s", "Label"]


def frame(spark, names):
    return spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "a")], [f"c{i}" for i in range(7)]).toDF(*names)


def test_both_header_styles_give_one_table(spark):
    want = ["flow_duration", "totlen_fwd_pkts", "fwd_header_len", "fwd_seg_size_min", "flow_byts_s", "label"]
    for names in (HEADERS_2017, HEADERS_2018):
        df = columns.standardize_columns(frame(spark, names), COLUMN_MAP)
        assert df.columns == want
        assert rows(df) == [(1.0, 2.0, 3.0, 5.0, 6.0, "a")]


def test_without_map_spaces_become_underscores(spark):
    df = columns.standardize_columns(frame(spark, HEADERS_2017))
    assert df.columns == ["flow_duration", "total_length_of_fwd_packets", "fwd_header_length",
                          "min_seg_size_forward", "flow_bytes/s", "label"]


def test_first_of_duplicate_columns_wins(spark):
    df = columns.drop_duplicate_columns(spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("x", "y", "x"))
    assert df.columns == ["x", "y"] and rows(df) == [(1, 2)]


def test_copy_suffix_only_at_the_end():
    assert columns.clean_name(" Fwd.1 Len.12 ") == "fwd.1 len"


def test_unmapped_columns(spark):
    df = spark.createDataFrame([(1, 2, "a")], ["flow_id", "odd", "label"])
    assert columns.unmapped_columns(df, COLUMN_MAP) == ["odd"]


def test_whitelist_projection(spark):
    df = spark.createDataFrame([(1, 2, "a")], ["b", "a", "label"])
    assert columns.project_features(df, ["a", "z", "b"]).columns == ["a", "b", "label"]
    assert columns.missing_from(df, ["a", "z"]) == ["z"]
    with pytest.raises(NoFeatures):
        columns.project_features(df, ["z"])


def test_align_reorders_drops_and_reports(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["c", "a", "b"])
    assert rows(columns.align_features(df, ["a", "b"])) == [(2, 3)]
    with pytest.raises(MissingFeatures) as error:
        columns.align_features(df, ["a", "y", "x"])
    assert error.value.names == ["x", "y"]


def test_label_separation(spark):
    df = spark.createDataFrame([(1.0, "x", "a")], ["n", "s", "label"])
    features, label = columns.split_label(df)
    assert features.columns == ["n", "s"] and label.columns == ["label"]
    assert columns.select_numeric(df).columns == ["n"]
    with pytest.raises(MissingLabel):
        columns.split_label(features)


def test_vocabulary_sizes(spark):
    assert len(COLUMN_MAP) == 134 and len(set(COLUMN_MAP.values())) == 84
    assert len(FEATURES) == len(set(FEATURES)) == 58 and len(TIME_FEATURES) == 15
    assert len(DISCRETE_FEATURES) == 28 and len(CONTINUOUS_FEATURES) == 30
    assert set(FEATURES) <= set(COLUMN_MAP.values())
    assert feature_table(spark).filter("kind = 'discrete'").count() == 28


def test_two_spellings_of_one_name_are_reported(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`fwd pkts` int, `total fwd` int, other int")
    names = {"fwd pkts": "tot_fwd", "total fwd": "tot_fwd"}
    assert columns.rename_collisions(df, names) == {"tot_fwd": ["fwd pkts", "total fwd"]}
    with pytest.raises(NameCollision, match="tot_fwd"):
        columns.rename_by_map(df, names)


def test_feature_kinds_in_both_spellings():
    assert feature_kinds([*FEATURES, "label"]) == ([c for c in FEATURES if c in DISCRETE_FEATURES], CONTINUOUS_FEATURES)
    assert feature_kinds(["idle_max", "flow_bytes/s", "syn_flag_count", "other"]) == (["syn_flag_count"], ["idle_max", "flow_bytes/s"])
