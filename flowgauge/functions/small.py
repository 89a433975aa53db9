"""Tables that are expected to be small: evaluate once, check, then reuse.

A fitted table (a few rows per class or feature) is brought to the driver when its
bytes have a bound: rows are fetched only as far as their declared width allows. Then
it is a local relation whose exact size the optimizer knows, so joins broadcast it under
Spark's own size threshold and no hint is needed. Beyond the bound the table is written
to the shared folder, with the same rows, and joins follow its real size.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from flowgauge.session import stored

MAX_BYTES = 8 * 1024 * 1024
# Bytes allowed for a value whose type has no fixed width, unless the caller knows better.
TEXT_WIDTH, ARRAY_WIDTH = 256, 4096


def declared_width(schema):
    """Bytes a row may take, from its types."""
    def one(kind):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return TEXT_WIDTH
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return ARRAY_WIDTH
        if isinstance(kind, T.StructType):
            return declared_width(kind)
        return 16
    return sum(one(f.dataType) for f in schema.fields)


def settle(df, width=None, max_bytes=MAX_BYTES):
    """The evaluated table; ``width`` is the bytes of a row where types do not tell."""
    head = bounded_arrow(df, width, max_bytes)
    return stored(df, "settled") if head is None else df.sparkSession.createDataFrame(head, df.schema)


def bounded_arrow(df, width=None, max_bytes=MAX_BYTES):
    """All rows if they are fewer than the bound allows for their width, else None."""
    most = max(1, max_bytes // (width or declared_width(df.schema)))
    head = df.limit(most + 1).toArrow()
    return None if head.num_rows > most else head


def local_table(spark, columns, schema):
    """A driver-made table from a dict of lists, as a local relation."""
    return spark.createDataFrame(pa.table(columns), schema)


def dense_index(distinct, column, index="idx"):
    """Number the sorted values of an already distinct column 0..n-1.

    Small inputs are numbered on the driver. Larger ones are range-partitioned and
    written, so that each partition's offset and its rows come from the same
    files, and no task sees more than one range.
    """
    spark = distinct.sparkSession
    values = distinct.select(column)
    head = bounded_arrow(values)
    schema = f"`{column}` {values.schema[0].dataType.simpleString()}, `{index}` bigint"
    if head is not None:
        ordered = sorted(v for v in head.column(0).to_pylist() if v is not None)
        arrays = {column: pa.array(ordered, head.column(0).type),
                  index: pa.array(range(len(ordered)), pa.int64())}
        return spark.createDataFrame(pa.table(arrays), schema)
    ranged = stored(values.filter(F.col(column).isNotNull()).repartitionByRange(column)
                    .withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_from"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(column))
    return (ranged.join(settle(offsets), "_part")
            .select(column, (F.col("_from") + place - 1).cast("bigint").alias(index)))
