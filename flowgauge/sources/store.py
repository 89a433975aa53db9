"""Fitted parameters, models and reports on shared storage."""

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from flowgauge.errors import NotFitted
from flowgauge.operators.centre_index import index_centres
from flowgauge.operators.detector import MODELS, Detector
from flowgauge.operators.drift import CENTROID_BYTES, DriftBaseline
from flowgauge.operators.profiles import Profiles
from flowgauge.plans.baseline import Baseline


def _read(reader, *parts):
    path = os.path.join(*parts)
    try:
        return reader.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise NotFitted(f"nothing saved at {path}") from error
        raise


def _versions(spark, path):
    return _read(spark.read.option("recursiveFileLookup", True), path, "versions").orderBy(F.desc("number"))


def _claimed(spark, file):
    """Whether this call made the file, which only one of several callers does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(file)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.getScheme() == "file":            # whose own create looks first and makes after
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(where, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _save(spark, path, tables):
    """Write all tables as a new version, claim the next free number and publish the
    version under it; returns the number. Several savers at once get a number each and
    none is lost; the highest is current. What was loaded from here before stays readable,
    and a save that breaks off leaves the last whole version in place (and maybe a gap
    in the numbers)."""
    name = f"version-{uuid.uuid4().hex}"
    for part, table in tables.items():
        if callable(table):
            table(os.path.join(path, name, part))
        else:
            table.write.parquet(os.path.join(path, name, part))
    try:
        number = _versions(spark, path).first()["number"] + 1
    except NotFitted:
        number = 1
    while not _claimed(spark, os.path.join(path, "claims", f"{number:010d}")):
        number += 1
    # A folder of its own: jobs that append to one folder at once remove each other's files.
    spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.lit(name).alias("name")).coalesce(1).write.parquet(
        os.path.join(path, "versions", f"{number:010d}"))
    return number


def _current(spark, path):
    """Folder of the last whole version."""
    return os.path.join(path, _versions(spark, path).first()["name"])


def save_baseline(baseline, path):
    _save(baseline.scaler.sparkSession, os.path.join(path, "baseline"), {"scaler": baseline.scaler, "labels": baseline.labels, "weights": baseline.weights})


def load_baseline(spark, path):
    folder = _current(spark, os.path.join(path, "baseline"))
    return Baseline(*[_read(spark.read, folder, part) for part in ("scaler", "labels", "weights")])


def save_drift(spark, drift, path):
    config = drift.config(spark).withColumn("features", F.array(*[F.lit(f) for f in drift.features]))
    _save(spark, os.path.join(path, "drift"), {"drift_config": config, "centroids": drift.centroid_table(spark)})


def load_drift(spark, path):
    folder = _current(spark, os.path.join(path, "drift"))
    config = _read(spark.read, folder, "drift_config").first()
    table = _read(spark.read, folder, "centroids")
    width = len(config["features"])
    if config["k_clusters"] * 8 * width > CENTROID_BYTES:
        centroids = index_centres(table, width)
    else:
        centroids = [list(r["centroid"]) for r in table.orderBy("cluster").collect()]
    return DriftBaseline(list(config["features"]), centroids, config["alpha"], config["mean_distance"],
                         config["std_distance"], config["ci_threshold"], config["base_outlier_ratio"],
                         config["base_was_zero"], config["or_threshold_t"], config["n_rows"])


def save_profiles(profiles, path):
    _save(profiles.marginals.sparkSession, os.path.join(path, "profiles"), {"marginals": profiles.marginals, "correlations": profiles.correlations})


def load_profiles(spark, path, label="label"):
    folder = _current(spark, os.path.join(path, "profiles"))
    marginals, correlations = _read(spark.read, folder, "marginals"), _read(spark.read, folder, "correlations")
    first = correlations.select("features").first()
    return Profiles(marginals, correlations, list(first["features"]) if first else [], label)


def _detector_tables(spark, detector):
    about = spark.range(1).select(F.lit(detector.kind).alias("kind"),
                                  F.array(*[F.lit(f) for f in detector.features]).alias("features"))
    return {"model": detector.model.save, "about": about}


def save_detector(spark, detector, path):
    return _save(spark, os.path.join(path, "detector"), _detector_tables(spark, detector))


def save_response(spark, response, events, path):
    """The refitted detector becomes the current one, in one version with its report and the
    events that it answers; returns the version's number."""
    tables = {**_detector_tables(spark, response.detector), "events": events}
    if response.report is not None:
        tables["report"] = response.report
    return _save(spark, os.path.join(path, "detector"), tables)


def answered_events(spark, path):
    """The events of all published responses, or None before the first. What a response
    that broke off has written is not among them."""
    root = os.path.join(path, "detector")
    try:
        # Versions that answer no event have no such folder.
        events = _read(spark.read, root, "version-*", "events")
        published = _versions(spark, root).select("name")
    except NotFitted:
        return None
    named = events.withColumn("name", F.regexp_extract(F.input_file_name(), "/(version-[0-9a-f]+)/events/", 1))
    return named.join(published, "name", "left_semi").drop("name")


def save_state(state, path, kind, part):
    """Mergeable state of one part of the data (a day, a file). Saving a part again replaces
    it, so a job that is repeated counts nothing twice."""
    return _save(state.sparkSession, os.path.join(path, "state", kind, str(part).encode().hex()), {"state": state})


def load_states(spark, path, kind):
    """The last saved state of every part, together; merge them to get the state of all."""
    root = os.path.join(path, "state", kind)
    saved = _read(spark.read.option("recursiveFileLookup", True), root, "*", "versions").select(
        "number", "name", F.regexp_extract(F.input_file_name(), "/([0-9a-f]+)/versions/", 1).alias("part"))
    last = saved.groupBy("part").agg(F.max(F.struct("number", "name")).alias("last")).select("part", "last.name").collect()
    return spark.read.parquet(*[os.path.join(root, row["part"], row["name"], "state") for row in last])


def load_detector(spark, path):
    folder = _current(spark, os.path.join(path, "detector"))
    about = _read(spark.read, folder, "about").first()
    return Detector(MODELS[about["kind"]].load(os.path.join(folder, "model")), list(about["features"]), about["kind"])


def write_report(report, path, by=()):
    """Report as CSV, one folder per dataset when ``by`` is given.

    A report has a few rows per label, so it is written as one file in row order.
    """
    ordered = report.orderBy(*by, "section", "label").drop("section").coalesce(1)
    writer = ordered.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)
