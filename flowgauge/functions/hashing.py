"""Seeded pseudo-random order that depends only on row content."""

from pyspark.sql import functions as F

SEED = 42


def order_key(columns, seed=SEED):
    """md5 text over key columns; the same order in every engine, run and retry."""
    parts = [F.col(f"`{name}`").cast("string") for name in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def row_key(columns, seed=SEED):
    """Hex text over whole rows, from a binary hash: no value is turned into text."""
    return F.lpad(F.hex(F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in columns])), 16, "0")


def shuffle_key(columns, keys=None, seed=SEED):
    return order_key(keys, seed) if keys else row_key(columns, seed)
