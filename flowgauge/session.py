"""Session defaults and the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the library is tuned for; a cluster's own values win when the
# session already exists.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app_name="flowgauge", master=None, **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder in ``spark.checkpoint.dir``. Only a session that runs in one process
    (``local[...]``, as in tests) may leave it unset: it gets a folder of its own, which
    goes with the process. On a cluster the setting is required."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="flowgauge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir("file://" + made)
    return "file://" + made


def stored(df, what="table"):
    """Written once as Parquet in the shared folder and read back: cuts lineage, survives
    lost executors, and gives the optimizer the table's real size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
