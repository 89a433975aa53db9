"""Value cleaning of numeric columns: one aggregate to look, one projection to fix."""

from pyspark.sql import functions as F

from flowgauge.errors import NoFeatures
from flowgauge.functions.columnwise import per_column, with_names
from flowgauge.functions.numeric import (finite_or_zero, is_finite, is_fractional,
                                         numeric_columns)


def _numeric_fields(df):
    chosen = set(numeric_columns(df))
    return [f for f in df.schema.fields if f.name in chosen]


_CLEAN, _MISSING, _INFINITE = 0, 1, 2


def _state(field):
    """One small number per value: finite, missing, or infinite."""
    column = F.col(f"`{field.name}`")
    missing = column.isNull()
    if not is_fractional(field.dataType):
        return F.when(missing, _MISSING).otherwise(_CLEAN)
    return (F.when(is_finite(field.name), _CLEAN).when(missing | F.isnan(column), _MISSING)
            .otherwise(_INFINITE))


def quality_profile(df):
    """Per numeric column: rows that are null or NaN, and rows that are infinite."""
    fields = _numeric_fields(df)
    if not fields:
        raise NoFeatures("no numeric column to profile")
    counts = per_column(df, [_state(f) for f in fields],
                        {"n_missing": lambda c: F.count_if(c == _MISSING),
                         "n_infinite": lambda c: F.count_if(c == _INFINITE)})
    return (with_names(counts, [f.name for f in fields], "column_name")
            .select("column_name", "n_missing", "n_infinite"))


def has_dirty_values(df):
    """Whether any numeric value is null, NaN or infinite; stops at the first one."""
    clean = F.lit(True)
    for field in _numeric_fields(df):
        clean = clean & F.coalesce(is_finite(field.name), F.lit(False))
    return not df.filter(~clean).isEmpty()


def clean_values(df, columns=None):
    """Null, NaN and infinity become 0 in numeric columns, in one projection."""
    wanted = set(numeric_columns(df) if columns is None else columns)
    return df.select(*[finite_or_zero(f).alias(f.name) if f.name in wanted else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def zero_columns(df, keep=()):
    """Names of numeric columns that hold nothing but 0, from one aggregate."""
    names = [c for c in numeric_columns(df) if c not in keep]
    if not names:
        return []
    in_use = [F.coalesce(F.col(f"`{c}`") != 0, F.lit(True)) for c in names]
    used = {r["ordinal"] for r in per_column(df, in_use, {"used": F.bool_or}).collect() if r["used"]}
    return [c for i, c in enumerate(names) if i not in used]


def drop_zero_columns(df, keep=()):
    """Without the all-zero numeric columns, except those in ``keep``."""
    return df.drop(*[F.col(f"`{c}`") for c in zero_columns(df, keep)])
