import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from flowgauge.errors import NoKnownLabels
from flowgauge.functions import small
from flowgauge.operators import labels


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"label {kind}")


def test_zero_label_as_number_and_text(spark):
    assert rows(labels.zero_to_normal(frame(spark, [0, 1, None], "int"))) == [("1",), ("normal",), (None,)]
    assert rows(labels.zero_to_normal(frame(spark, ["0", "00", "x"]))) == [("00",), ("normal",), ("x",)]


def test_upper_aliases_and_null(spark):
    df = labels.map_labels(labels.upper_label(frame(spark, ["ftp-bruteforce", "Ssh-BruteForce", "Bot", None])))
    assert rows(df) == [("BOT",), ("FTP-PATATOR",), ("NAN",), ("SSH-PATATOR",)]


def test_dictionary_is_sorted_and_dense(spark):
    known = labels.fit_labels(frame(spark, ["b", "a", "b", "Z", "é"]))
    assert rows(known.orderBy("idx"), "idx", "label") == [(0, "Z"), (1, "a"), (2, "b"), (3, "é")]


def test_dictionary_over_the_driver_bound(spark, monkeypatch):
    monkeypatch.setattr(small.bounded_arrow, "__defaults__", (None, 20 * small.TEXT_WIDTH))
    values = [f"{(i * 7919) % 1000:04d}" for i in range(1000)]
    known = labels.fit_labels(frame(spark, values))
    assert [tuple(r) for r in known.orderBy("label").collect()] == [(f"{i:04d}", i) for i in range(1000)]


def test_unknown_label_fails_encoding(spark):
    known = labels.fit_labels(frame(spark, ["a", "b"]))
    assert rows(labels.encode_labels(frame(spark, ["b", "a"]), known)) == [("a", 0), ("b", 1)]
    with pytest.raises(PySparkException, match="unknown label: c"):
        labels.encode_labels(frame(spark, ["a", "c"]), known).collect()


def test_known_filter_and_retention(spark):
    known = labels.fit_labels(frame(spark, ["a", "b"]))
    df = frame(spark, ["a", "c", "a", None])
    assert rows(labels.require_known_labels(df, known)) == [("a",), ("a",)]
    assert rows(labels.retention(df, known)) == [(4, 2, 0.5)]
    with pytest.raises(NoKnownLabels):
        labels.require_known_labels(frame(spark, ["c"]), known)


def test_census_is_descending(spark):
    census = labels.label_census(frame(spark, ["a", "b", "b", "c", "b", "c"])).collect()
    assert [tuple(r) for r in census] == [("b", 3), ("c", 2), ("a", 1)]
    assert labels.rows_of_label(frame(spark, ["a", "b"]), "a").count() == 1


def test_settle_gives_the_same_rows_beyond_the_bound(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert small.declared_width(df.schema) == 32
    for bound in (10 * 32, 50 * 32, 1):
        kept = small.settle(df, max_bytes=bound)
        assert kept.schema.simpleString() == df.schema.simpleString()
        assert kept.agg(F.sum("x")).first()[0] == 2450
    assert small.bounded_arrow(df, max_bytes=49 * 32) is None
