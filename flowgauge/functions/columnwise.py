"""The same aggregates over many columns, in one pass."""

from pyspark.sql import functions as F

# A wide aggregate leaves whole-stage codegen above spark.sql.codegen.maxFields
# (100 unless set). With 58 features and two aggregates each, turning the columns
# into rows first took two thirds of its time, so wide tables go that way. Both ways
# give the same rows.
WIDE_LIMIT = 80


def per_column(df, cells, aggregates, by=()):
    """(by ..., ordinal, aggregate ...): one row per cell expression and group.

    ``cells`` are column expressions of one type; ``aggregates`` maps names to
    functions from a column to an aggregate that passes over nulls. Without groups an
    empty table also gives one row per cell.
    """
    keys = [F.col(f"`{c}`") for c in by]
    named = df.select(*keys, *[cell.alias(f"_{i}") for i, cell in enumerate(cells)])
    if len(cells) * len(aggregates) > WIDE_LIMIT:
        rows = named.select(*keys, F.posexplode(F.array(*[f"_{i}" for i in range(len(cells))]))
                            .alias("ordinal", "_cell"))
        if not by:      # a null per cell, so that a table without rows has its groups too
            rows = rows.unionByName(df.sparkSession.range(len(cells)).select(
                F.col("id").cast("int").alias("ordinal"), F.lit(None).cast(rows.schema["_cell"].dataType).alias("_cell")))
        return rows.groupBy(*keys, "ordinal").agg(*[how(F.col("_cell")).alias(name)
                                                    for name, how in aggregates.items()])
    wide = named.groupBy(*keys).agg(*[how(F.col(f"_{i}")).alias(f"_{i}_{name}")
                                      for i in range(len(cells)) for name, how in aggregates.items()])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), *[F.col(f"_{i}_{name}").alias(name) for name in aggregates])
        for i in range(len(cells))])))


def with_names(table, names, column):
    """Replace ``ordinal`` by the name at that position."""
    listed = F.array(*[F.lit(n) for n in names])
    return table.withColumn(column, F.element_at(listed, F.col("ordinal") + 1))
