"""What the corpus operators share: picking columns, adding columns batch by batch,
and a name in the shared folder."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowgauge.session import shared_folder


def positions(df, *needed):
    """The frame with columns renamed by place, and the new names of ``needed``.

    Other columns may repeat a name or clash with one an operator makes, so work is
    done under place names; ``toDF(*df.columns)`` gives the old names back."""
    columns = df.columns
    missing = [n for n in needed if n not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.toDF(*[f"c{i}" for i in range(len(columns))]), {n: f"c{columns.index(n)}" for n in needed}


def pick(df, *needed):
    """Only the named columns, whatever else the table holds."""
    plain, at = positions(df, *needed)
    return plain.select(*[F.col(at[n]).alias(n) for n in needed])


def new_folder(spark, what):
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def add_columns(df, make, schema):
    """Appends what ``make(batch)`` returns (a list of Arrow arrays) to every batch."""
    added = StructType.fromDDL(schema).fields
    names = df.columns + [f.name for f in added]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in added]]))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
