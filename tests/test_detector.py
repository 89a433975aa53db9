import numpy as np
import pytest

from conftest import rows
from flowgauge.errors import MissingLabel, NotFitted
from flowgauge.operators import detector, drift, evaluation, profiles
from flowgauge.plans.baseline import (apply_baseline, fit_baseline, fit_on_split, prepare_new, prepare_old)
from flowgauge.plans.response import respond
from flowgauge.sources import store

FEATURES = ["x", "y"]


def clusters(spark, n=300, shift=0.0, seed=0, names=("benign", "dos", "xss")):
    random = np.random.default_rng(seed)
    which = random.choice(3, n, p=[0.6, 0.3, 0.1])
    x = which * 4.0 + random.normal(0, 0.4, n) + shift
    y = (which % 2) * 4.0 + random.normal(0, 0.4, n)
    return spark.createDataFrame([(i, float(a), float(b), names[w]) for i, (a, b, w) in enumerate(zip(x, y, which))],
                                 "id int, x double, y double, label string")


@pytest.fixture(scope="module")
def fitted(spark):
    old = prepare_old(clusters(spark))
    train, test, baseline = fit_on_split(old, keys=["id"])
    return old, apply_baseline(train, baseline), apply_baseline(test, baseline), baseline


def test_split_and_baseline(fitted):
    old, train, test, baseline = fitted
    assert train.count() + test.count() == old.count() == 300
    assert baseline.features == FEATURES
    assert [r.label for r in baseline.labels.orderBy("idx").collect()] == ["BENIGN", "DOS", "XSS"]
    assert all(1.0 <= r.weight <= 8.2 for r in baseline.weights.collect())


@pytest.mark.parametrize("kind", ["perceptron", "logistic", "forest"])
def test_detectors_learn_planted_clusters(fitted, kind):
    _, train, test, baseline = fitted
    weight = None if kind == "perceptron" else "weight"
    rows = detector.with_weights(train, baseline.weights) if weight else train
    model = detector.fit_detector(rows, FEATURES, 3, hidden=(8,), max_iter=60, weight_col=weight, kind=kind)
    scored = model.predict(test, baseline.labels)
    assert evaluation.accuracy(scored, "label", "p").first()[0] > 95
    assert scored.columns[-1] == "p" and len(scored.first()["probability"]) == 3


def test_perceptron_refuses_weights(fitted):
    with pytest.raises(ValueError):
        detector.fit_detector(fitted[1], FEATURES, 3, weight_col="x", kind="perceptron")


def test_history_goes_on_from_the_last_round(fitted):
    _, train, test, _ = fitted
    model, history = detector.fit_with_history(train, test, FEATURES, 3, hidden=(8,), rounds=3, iterations=10)
    found = history.orderBy("round", "iteration").collect()
    losses = [r.train_loss for r in found]
    assert {r["round"] for r in found} == {1, 2, 3} and losses[0] > losses[-1]
    assert [r.iteration for r in found if r["round"] == 1] == list(range(1, sum(r["round"] == 1 for r in found) + 1))
    assert sum(r.val_accuracy is not None for r in found) == 3 and found[-1].val_accuracy > 90
    reports = []
    detector.fit_with_history(train, test, FEATURES, 3, hidden=(8,), rounds=2, iterations=5, reports=reports)
    assert [r.agg({"n": "sum"}).first()[0] for r in reports] == [test.count()] * 2
    assert detector.validate(model, test)[1] > 90


def test_store_round_trip(spark, fitted, tmp_path):
    old, train, test, baseline = fitted
    path = str(tmp_path / "saved")
    with pytest.raises(NotFitted):
        store.load_baseline(spark, path)
    store.save_baseline(baseline, path)
    again = store.load_baseline(spark, path)
    assert apply_baseline(old, again).exceptAll(apply_baseline(old, baseline)).isEmpty()

    fit = drift.fit_drift(train, FEATURES, k=3, alpha=2.0, max_iter=5)
    store.save_drift(spark, fit, path)
    assert store.load_drift(spark, path) == fit

    shapes = profiles.fit_profiles(old, [], FEATURES, keys=["id"])
    store.save_profiles(shapes, path)
    assert store.load_drift(spark, path) == fit
    loaded = store.load_profiles(spark, path)
    for more in ("BENIGN", "DOS"):      # saved back to where it was loaded from, twice
        again = profiles.fit_profiles(old.filter(f"label = '{more}'"), [], FEATURES, existing=store.load_profiles(spark, path))
        store.save_profiles(again, path)
        assert rows(store.load_profiles(spark, path).labels()) == [("BENIGN",), ("DOS",), ("XSS",)]
    loaded = store.load_profiles(spark, path)
    quota = spark.createDataFrame([("DOS", 20)], "label string, quota bigint")
    assert profiles.draw(loaded, quota).exceptAll(profiles.draw(shapes, quota)).isEmpty()

    model = detector.fit_detector(train, FEATURES, 3, hidden=(8,), max_iter=10)
    store.save_detector(spark, model, path + "/detector")
    same = store.load_detector(spark, path + "/detector")
    assert same.predict(test).select("predicted").exceptAll(model.predict(test).select("predicted")).isEmpty()


@pytest.mark.parametrize("quota", ["match", "equal"])
def test_response(spark, fitted, tmp_path, quota):
    old, train, test, baseline = fitted
    scaled = apply_baseline(old, baseline)
    fit = drift.fit_drift(scaled, FEATURES, k=3, alpha=2.0, max_iter=10)
    shapes = profiles.fit_profiles(old.filter("label <> 'XSS'"), [], FEATURES, keys=["id"])
    unchanged = prepare_new(clusters(spark, seed=9))
    assert not respond(unchanged, test, baseline, fit, shapes, keys=["id"])
    old_detector = detector.fit_detector(train, FEATURES, 3, hidden=(8,), max_iter=30)
    calm = respond(unchanged, test, baseline, fit, shapes, keys=["id"], before=old_detector)
    assert not calm and calm.detector is old_detector and rows(calm.report, "phase", "dataset") != []
    moved = prepare_new(clusters(spark, shift=2.0, seed=9, names=("benign", "dos", "unheard of")))
    response = respond(moved, test, baseline, fit, shapes, quota=quota, keys=["id"], hidden=(8,), max_iter=60,
                       before=old_detector, rounds=3)
    assert response and response.history.agg({"round": "max"}).first()[0] == 3
    accuracy = {(r.phase, r.dataset): r.precision for r in response.report.filter("label = 'accuracy'").collect()}
    assert accuracy["before", "new"] <= accuracy["after", "new"]
    response.report = response.report.filter("phase = 'after'").drop("phase")
    accuracy = {d: a for (phase, d), a in accuracy.items() if phase == "after"}
    assert set(accuracy) == {"new", "old", "hybrid"} and accuracy["new"] > 0.9
    missing = [r.label for r in response.missing.collect()]
    assert missing == ([] if quota == "match" else ["XSS"])
    store.write_report(response.report, str(tmp_path / "report"), by=["dataset"])
    saved = spark.read.csv(str(tmp_path / "report"), header=True)
    assert saved.count() == 3 * (3 + 3) and "f1_score" in saved.columns


def test_prepare_old_and_new(spark):
    raw = spark.createDataFrame([(1.0, 0.0, float("inf"), 0), (2.0, 0.0, 1.0, 1)],
                                "` A B` double, Zero double, `Rate.1` double, ` Label` int")
    old = prepare_old(raw)
    assert old.columns == ["a_b", "rate", "label"]
    assert sorted(tuple(r) for r in old.collect()) == [(1.0, 0.0, "NORMAL"), (2.0, 1.0, "1")]
    assert prepare_new(raw).columns == ["a_b", "zero", "rate", "label"]
    all_zero = prepare_old(raw.filter("` Label` = 0"))
    assert [r.label for r in all_zero.collect()] == ["NORMAL"]
    with pytest.raises(MissingLabel):
        prepare_old(raw.drop(" Label"))


def test_baseline_of_a_wide_table(spark):
    names = [f"f{i}" for i in range(60)]
    data = [(*[float((r * 7 + i) % 13) for i in range(60)], "ab"[r % 2]) for r in range(50)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", label string")
    baseline = fit_baseline(df, names)
    low = {r.feature: (r.low, r.high) for r in baseline.scaler.collect()}
    assert low == {n: (min(d[i] for d in data), max(d[i] for d in data)) for i, n in enumerate(names)}
    assert baseline.features == names
    assert [(r.label, r.n) for r in baseline.weights.orderBy("idx").collect()] == [("a", 25), ("b", 25)]
