"""Running totals over a sorted table that no single task has to see whole."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgauge.session import stored


def running_totals(rows, keys, order, value, into, what="ranged"):
    """Adds ``into``: the sum of ``value`` over the rows before this one in ``order``,
    among rows with equal ``keys`` (which must not be null). ``order`` has to tell rows
    apart, or rows that tie must be interchangeable.

    Rows are range-sorted on keys and order, so a hot key is cut into many ranges; each
    range adds up on its own and starts from the sum of the ranges before it. Rows that
    tie get a random place among each other, so that many of them are cut up as well; the
    places are written before they are used.
    """
    placed = rows.withColumn("_tie", F.rand(7)).repartitionByRange(*keys, *order, "_tie")
    ranged = stored(placed.withColumn("_part", F.spark_partition_id()), what)
    total = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = total.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    return (ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [*keys, "_part"])
            .withColumn(into, F.col("_start") + F.col("_inside"))
            .drop("_part", "_start", "_inside", "_tie"))
