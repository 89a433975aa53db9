"""Binary per-attack exports: the label's meaning comes from the source file."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.operators.columns import require_label
from flowgauge.sources.flow_csv import read_flow_csv
from flowgauge.sources.names import ATTACK_BY_SOURCE, NORMAL


def relabel_sources(df, source, source_map=None, label="label", normal=NORMAL):
    """0 becomes ``normal``, 1 the attack of the row's source; other values stay."""
    require_label(df, label)
    # A handful of literals: no join.
    pairs = (ATTACK_BY_SOURCE if source_map is None else source_map).items()
    attacks = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    attack = F.try_element_at(attacks, F.col(source))
    column = F.col(label)
    if isinstance(df.schema[label].dataType, T.StringType):
        column = column.try_cast("double")
    named = F.when(column == 0, F.lit(normal)).when((column == 1) & attack.isNotNull(), attack)
    return df.withColumn(label, named.otherwise(F.col(label).cast("string")))


def relabel_files(spark, paths, output, source_map=None, label="Label", encoding="auto"):
    """Read all files at once, relabel by file, write Parquet partitioned by source.

    No index column is added. Files must share one header.
    """
    cells = read_flow_csv(spark, paths, encoding=encoding, source_column="source")
    relabel_sources(cells, "source", source_map, label).write.mode("overwrite").partitionBy("source").parquet(output)
