"""Column names and projections. All of it is schema work; no job runs."""

import re

from pyspark.sql import functions as F

from flowgauge.errors import MissingFeatures, MissingLabel, NameCollision, NoFeatures
from flowgauge.functions.numeric import numeric_columns

_COPY_SUFFIX = re.compile(r"\.\d+$")


def clean_name(raw):
    """Trimmed, lower-case, without the ``.1`` a reader adds to a repeated header."""
    return _COPY_SUFFIX.sub("", raw.strip().lower())


def _rename_keeping_first(df, names):
    # Positional names first: equal names would be ambiguous in an expression.
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return positional.select(*[F.col(f"_{i}").alias(name) for name, i in first.items()])


def clean_names(df):
    return _rename_keeping_first(df, [clean_name(c) for c in df.columns])


def drop_duplicate_columns(df):
    """Keep the first of columns with the same name."""
    return _rename_keeping_first(df, df.columns)


def underscore_names(df):
    return _rename_keeping_first(df, [c.replace(" ", "_") for c in df.columns])


def rename_collisions(df, rename_map):
    """Canonical names that several columns map to, each with those columns."""
    spelled = {}
    for c in df.columns:
        spelled.setdefault(rename_map.get(c, c), []).append(c)
    return {name: columns for name, columns in spelled.items() if len(set(columns)) > 1}


def rename_by_map(df, rename_map):
    """Canonical names for known spellings. Two spellings of one name in a table are an
    error: which of the columns is meant cannot be told (see ``rename_collisions``)."""
    clashes = rename_collisions(df, rename_map)
    if clashes:
        raise NameCollision(clashes)
    return _rename_keeping_first(df, [rename_map.get(c, c) for c in df.columns])


def standardize_columns(df, rename_map=None):
    """Clean the names, then use the synonym map or, without one, underscores."""
    cleaned = clean_names(df)
    return rename_by_map(cleaned, rename_map) if rename_map else underscore_names(cleaned)


def unmapped_columns(df, rename_map, label="label"):
    """Columns that are no canonical name, in table order."""
    canonical = set(rename_map.values()) | {label}
    return [c for c in df.columns if c not in canonical]


def missing_from(df, whitelist):
    return [c for c in whitelist if c not in df.columns]


def project_features(df, whitelist, label="label"):
    """Whitelisted columns in whitelist order, and the label if there is one."""
    kept = [c for c in whitelist if c in df.columns and c != label]
    if not kept:
        raise NoFeatures("no whitelisted feature in the table")
    return df.select(*[f"`{c}`" for c in kept], *([label] if label in df.columns else []))


def select_numeric(df):
    return df.select(*[f"`{c}`" for c in numeric_columns(df)])


def require_label(df, label="label"):
    if label not in df.columns:
        raise MissingLabel(f"no column {label!r}")
    return df


def split_label(df, label="label"):
    """(features, label) as two projections of the same rows."""
    require_label(df, label)
    return df.drop(label), df.select(label)


def align_features(df, fitted, keep=()):
    """Fitted features in fitted order, then ``keep``; extras are dropped."""
    missing = missing_from(df, fitted)
    if missing:
        raise MissingFeatures(missing)
    return df.select(*[f"`{c}`" for c in fitted], *keep)
