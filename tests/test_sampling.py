import hashlib
import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from flowgauge.operators import sampling


def key_of(row, seed=42):
    return hashlib.md5("|".join([str(seed), *map(str, row)]).encode()).hexdigest()


def frame(spark, data):
    return spark.createDataFrame(data, "k int, label string")


def brute_force(data, quota):
    """The first rows of each class in hash order, one by one."""
    taken = Counter()
    for label in {d[1] for d in data}:
        members = sorted((d for d in data if d[1] == label), key=lambda d: (key_of(d), d))
        taken.update(members[:quota(len(members))])
    return taken


def test_split_matches_brute_force(spark):
    data = [(i, "big") for i in range(900)] + [(i, "mid") for i in range(90)] + [(1, "one"), (1, "two"), (2, "two")]
    split = sampling.stratified_split(frame(spark, data), keys=["k", "label"])
    assert Counter(tuple(r) for r in split.select("k", "label").collect()) == Counter(data)
    test = Counter(tuple(r) for r in split.filter("split = 'test'").select("k", "label").collect())
    assert test == brute_force(data, lambda n: math.ceil(0.3 * n) if n > 1 else 0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from("ab")), min_size=1, max_size=60), st.integers(0, 20))
def test_cap_is_exact_with_copies(spark, data, cap):
    kept = sampling.cap_classes(frame(spark, data), cap=cap, keys=["k", "label"])
    got = Counter(tuple(r) for r in kept.collect())
    assert got == brute_force(data, lambda n: min(n, cap))


def test_cut_is_narrowed_to_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "WITHIN", 5)
    steps, real = [], sampling._narrowed
    monkeypatch.setattr(sampling, "_narrowed", lambda *a: steps.append(real(*a)) or steps[-1])
    unique = [(i, "u") for i in range(3000)]
    constant = [(7, "c")] * 500
    mostly = [(1, "m")] * 400 + [(i, "m") for i in range(2, 300)]
    data = unique + constant + mostly
    kept = sampling.choose(frame(spark, data), "label", lambda n: F.least(n, F.lit(350)), ["k", "label"], digits=1)
    kept = kept.filter("chosen").drop("chosen")
    assert Counter(tuple(r) for r in kept.collect()) == brute_force(data, lambda n: min(n, 350))
    last = {r["_of"]: r for r in steps[-1].collect()}
    assert len(steps) > 1 and all(r["_rows"] <= 5 or r["_one"] for r in last.values())


def test_one_row_with_most_of_the_copies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK", 100)
    data = frame(spark, [(i, "a") for i in range(20)])
    data = data.unionByName(spark.range(1000).select(F.lit(7).alias("k"), F.lit("a").alias("label")))
    split = sampling.stratified_split(data)
    assert rows(split.groupBy("split").count()) == [("test", 306), ("train", 714)]
    assert split.groupBy("k").count().filter("k = 7").first()["count"] == 1001


def test_deciding_needs_no_shuffle_unless_rows_share_the_cut(spark):
    def plan(data):
        return sampling.stratified_split(frame(spark, data))._jdf.queryExecution().executedPlan().toString()

    assert "Exchange hashpartitioning" not in plan([(i, "a") for i in range(100)])
    assert "Exchange hashpartitioning" in plan([(1, "a")] * 100)


def test_rows_that_differ_outside_the_hashed_columns(spark):
    data = spark.createDataFrame([(1, i, "a") for i in range(10)], "k int, v int, label string")
    kept = sampling.cap_classes(data, cap=4, keys=["k"])
    assert rows(kept, "v") == [(0,), (1,), (2,), (3,)]


def test_null_class_has_a_quota(spark):
    data = [(i, None) for i in range(10)] + [(i, "a") for i in range(5)]
    assert rows(sampling.cap_classes(frame(spark, data), cap=4).groupBy("label").count()) == [("a", 4), (None, 4)]


def test_quota_table(spark):
    data = [(i, c) for c in "abc" for i in range(10)]
    quota = spark.createDataFrame([("a", 3), ("b", 99)], "label string, quota int")
    assert rows(sampling.take_quota(frame(spark, data), quota).groupBy("label").count()) == [("a", 3), ("b", 10)]


def test_undersample_cuts_only_the_named_class(spark):
    data = [(i, "BENIGN") for i in range(50)] + [(i, "DOS") for i in range(30)]
    cut = sampling.undersample(frame(spark, data), target=20)
    assert rows(cut.groupBy("label").count()) == [("BENIGN", 20), ("DOS", 30)]


def test_small_classes(spark):
    data = [(0, "one")] + [(i, "nine") for i in range(9)] + [(i, "ten") for i in range(10)]
    known = spark.createDataFrame([("one",), ("nine",), ("ten",), ("none",)], "label string")
    assert rows(sampling.small_classes(frame(spark, data), known)) == [
        ("nine", 9, "few"), ("none", 0, "empty"), ("one", 1, "few"), ("ten", 10, "ok")]


def test_shuffle_keeps_all_rows(spark):
    data = [(i, "a") for i in range(100)]
    shuffled = [r.k for r in sampling.shuffle_rows(frame(spark, data)).collect()]
    assert sorted(shuffled) == list(range(100)) and shuffled != list(range(100))


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, i % 2, "a") for i in range(40)], "`v.1` double, `r/s` int, label string")
    split = sampling.stratified_split(df)
    assert split.columns == ["v.1", "r/s", "label", "split"]
    assert rows(split.groupBy("split").count()) == [("test", 12), ("train", 28)]
