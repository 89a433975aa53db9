"""Flow CSV files: header handling, per-file encoding, numbers in all spellings."""

import csv
from collections import Counter

from pyspark.sql import functions as F

from flowgauge.errors import HeaderMismatch
from flowgauge.session import stored
from flowgauge.sources.names import TEXT_COLUMNS

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"


def header_names(line):
    """Header cells; a repeated name gets ``.1``, ``.2`` ..., never a position number."""
    seen = Counter()
    names = []
    for cell in next(csv.reader([line])):
        names.append(f"{cell}.{seen[cell]}" if seen[cell] else cell)
        seen[cell] += 1
    return names


def inspect_files(lines, header):
    """(file, valid_utf8, n_header) of every file, from one pass over the raw bytes of
    every line.

    The text reader keeps the bytes as they are, so validity is exact, unlike a
    search for replacement characters, which may also be genuine.
    """
    return lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"),
                                     F.count_if(F.col("value") == header).alias("n_header"))


def _first_line(spark, paths):
    first = spark.read.text(paths[0] if isinstance(paths, list) else paths).first()
    if first is None:
        raise HeaderMismatch("no header line: the file is empty")
    return first["value"]


def read_flow_csv(spark, paths, text_columns=TEXT_COLUMNS, encoding="auto", numbers="declared",
                  source_column=None):
    """Table of a set of CSV files that share one header.

    ``encoding="auto"`` reads each file as UTF-8 when all its bytes are, otherwise
    as Latin-1; a named encoding (one that keeps ASCII as it is) holds for all. Either way
    a pass over the lines checks that every file has the first one's header, and its
    result, a row per file, stays a table: the files may be many. Columns named in
    ``text_columns`` (after trimming, in any case) stay text, the others become
    doubles. With ``numbers="inferred"`` only columns whose every value is a number
    do. Values are read as text and cast, because a declared double column would
    turn some spellings of infinity into null. ``source_column`` adds the part of the
    file name before the first underscore or dot.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    first = _first_line(spark, paths)
    header = header_names(first)
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    files = stored(inspect_files(lines, first), "files")
    strange = [r["file"] for r in files.filter("n_header = 0").orderBy("file").limit(5).collect()]
    if strange:
        raise HeaderMismatch(f"other header than the first file: {', '.join(strange)}")
    table = _cells(lines, files, first, len(header), encoding)
    text = [i for i, c in enumerate(header) if c.strip().lower() in text_columns]
    if numbers == "inferred":
        text = sorted({*text, *_not_numeric(table, len(header))})
    cells = [F.col(f"_{i}") if i in text else F.col(f"_{i}").try_cast("double") for i in range(len(header))]
    source = [F.col("_source").alias(source_column)] if source_column else []
    return table.select(*[cell.alias(name) for cell, name in zip(cells, header)], *source)


def _cells(lines, files, header, width, encoding):
    """Every line but the headers as text cells, decoded by its file's encoding."""
    raw = F.col("value").cast("binary")
    if encoding == "auto":
        lines = lines.join(files.select("file", "valid_utf8"), "file")
        line = F.when(F.col("valid_utf8"), F.col("value")).otherwise(F.decode(raw, LATIN1))
    else:
        line = F.decode(raw, encoding)
    schema = ", ".join(f"_{i} string" for i in range(width))
    blank = F.trim("value") == ""
    parsed = lines.filter((F.col("value") != F.lit(header)) & ~blank).select(
        F.from_csv(line, schema, {"escape": '"'}).alias("_line"),
        F.regexp_extract(F.regexp_extract("file", r"([^/]*)$", 1), r"^([^_.]+)", 1).alias("_source"))
    return parsed.select("_line.*", "_source")


def _not_numeric(table, width):
    failed = table.agg(*[F.count_if(F.col(f"_{i}").isNotNull() & F.col(f"_{i}").try_cast("double").isNull())
                         .alias(f"_{i}") for i in range(width)]).first()
    return [i for i in range(width) if failed[i]]
