"""Exact per-class selection by hash order: splits, caps and undersampling.

The order of the rows of a class is the order of a hash of their content: an md5
over key columns when they are named, else a binary hash of the whole row. So a
selection is the same on every run, cluster and retry. Taking the first ``q`` rows
of a class does not sort the class:

1. count rows per (class, hash prefix), a map-side-combined aggregate, and find per
   class the prefix in which the running count reaches ``q``;
2. lengthen the prefix inside the one that was found, until it holds few rows or one
   hash: a step more for every thousandfold in rows, whatever share a class has;
3. count rows per hash within that prefix and find the hash at which ``q`` is reached;
   when keys are named, only they have been read so far;
4. compare every row's hash with its class's cut, where the row is read: a join
   with one row per class and no shuffle of the data.

A class's size thus never reaches a task; a window sees at most ``WITHIN`` rows or the
prefixes of one step. The steps run the input's plan again: give a costly input as a
written table.

Only when rows share the cut hash and some of them are over the quota is there a last
step. Those rows are counted per distinct row, not numbered, so a row with most of the
copies stays a single counted row until it is written out in blocks; distinct rows are
summed up in ranges.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgauge.functions.hashing import SEED, shuffle_key
from flowgauge.functions.running import running_totals
from flowgauge.functions.small import settle
from flowgauge.sources.names import LABEL, MAJORITY

PREFIX_DIGITS = 3
WITHIN = 10_000
COPIES_PER_TASK = 100_000
TEST_SHARE = 0.3
CLASS_CAP = 50_000
TARGET_PER_CLASS = 15_000

# Sorts after every hex digit: the whole class lies below it.
_WHOLE_CLASS = "~"


def choose(df, label, quota, keys=None, seed=SEED, digits=PREFIX_DIGITS, column="chosen"):
    """Flag exactly ``quota`` rows per class, the first in hash order.

    ``quota`` maps the class size (a column) to a number, or is a table
    (label, quota). A class without a quota keeps nothing. ``keys`` names the
    columns to hash; without them the whole row is hashed.
    """
    columns = quoted(df)
    keyed = df.withColumn("_order", shuffle_key(df.columns, keys, seed))
    cuts = _cuts(keyed.select(F.col(label).alias("_class"), "_order"), label, quota, digits)
    marked = keyed.join(cuts, keyed[label].eqNullSafe(cuts["_class"]), "left").drop("_class")
    below = F.coalesce((F.col("_order") < F.col("_cut")) | ((F.col("_order") == F.col("_cut")) & ~F.col("_shared")),
                       F.lit(False))
    if cuts.filter("_shared").isEmpty():
        return marked.select(*columns, below.alias(column))
    divided = F.coalesce(F.col("_shared") & (F.col("_order") == F.col("_cut")), F.lit(False))
    decided = marked.filter(~divided).select(*columns, below.alias(column))
    return decided.unionByName(_divide(marked.filter(divided), columns, label, column))


def quoted(df):
    return [f"`{c}`" for c in df.columns]


def _running(count, by, order):
    """Count up to and including a row, in order."""
    return F.sum(count).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def _narrowed(hashes, near, quota, label, length, digits):
    """(_of, _within, _need, _rows, _one): per class the prefix of ``length + digits`` in
    which the quota is reached, how many of its rows are to be taken, how many it has,
    and whether they share one hash. ``near`` is the step before, or None."""
    longer = hashes.withColumn("_prefix", F.substring("_order", 1, length + digits))
    if near is not None:
        known = near.filter(F.col("_within") != _WHOLE_CLASS).select("_of", "_within", "_need")
        longer = longer.join(known, longer["_class"].eqNullSafe(known["_of"]) & (F.substring("_order", 1, length) == known["_within"]))
    needed = [] if near is None else ["_need"]
    sizes = longer.groupBy("_class", "_prefix", *needed).agg(
        F.count(F.lit(1)).alias("_n"), (F.min("_order") == F.max("_order")).alias("_one"))
    sizes = sizes.withColumns({"_upto": _running("_n", "_class", ["_prefix"]), "_size": F.sum("_n").over(W.partitionBy("_class"))})
    if near is not None:
        sizes = sizes.withColumn("_quota", F.col("_need"))
    elif callable(quota):
        sizes = sizes.withColumn("_quota", quota(F.col("_size")).cast("bigint"))
    else:
        wanted = quota.select(F.col(label).alias("_for"), F.col("quota").cast("bigint").alias("_quota"))
        sizes = sizes.join(wanted, sizes["_class"].eqNullSafe(wanted["_for"])).drop("_for")
    before = F.col("_upto") - F.col("_n")
    whole = F.lit(near is None) & (F.col("_quota") >= F.col("_size"))
    reached = (before < F.col("_quota")) & (F.col("_quota") <= F.col("_upto"))
    last = F.col("_upto") == F.col("_size")
    found = sizes.filter((F.col("_quota") > 0) & F.when(whole, last).otherwise(reached)).select(
        F.col("_class").alias("_of"), F.when(whole, _WHOLE_CLASS).otherwise(F.col("_prefix")).alias("_within"),
        (F.col("_quota") - before).alias("_need"), F.when(whole, 0).otherwise(F.col("_n")).alias("_rows"), "_one")
    if near is not None:
        found = found.unionByName(near.filter(F.col("_within") == _WHOLE_CLASS))
    return settle(found)


def _cuts(hashes, label, quota, digits):
    """(_class, _cut, _left, _shared): the last hash taken, how many of its rows are
    taken, and whether that is not all of them."""
    near, length = None, 0
    while near is None or not near.filter((F.col("_rows") > WITHIN) & ~F.col("_one")).isEmpty():
        near = _narrowed(hashes, near, quota, label, length, digits)
        length += digits
    inside = hashes.join(near, hashes["_class"].eqNullSafe(near["_of"]) & (F.substring("_order", 1, length) == F.col("_within")))
    counted = inside.groupBy("_class", "_order", "_need").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_left", F.col("_need") - _running("_n", "_class", ["_order"]) + F.col("_n"))
    exact = (counted.filter(F.col("_left").between(1, F.col("_n")))
             .select("_class", F.col("_order").alias("_cut"), "_left", (F.col("_left") < F.col("_n")).alias("_shared")))
    all_rows = near.filter(F.col("_within") == _WHOLE_CLASS).select(
        F.col("_of").alias("_class"), F.col("_within").alias("_cut"), F.lit(0).cast("bigint").alias("_left"),
        F.lit(False).alias("_shared"))
    return settle(exact.unionByName(all_rows))


def _divide(rows, columns, label, column):
    """Split rows with the same hash: distinct rows in order, copies by number."""
    groups = rows.groupBy(*columns, "_order", "_left").agg(F.count(F.lit(1)).alias("_copies"))
    groups = groups.withColumns({"_none": F.col(label).isNull(), "_key": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    placed = running_totals(groups, ["_none", "_key"], columns, "_copies", "_before", "divided")
    placed = placed.withColumn("_taken", F.greatest(F.lit(0), F.least(F.col("_copies"), F.col("_left") - F.col("_before"))))
    parts = placed.select(*columns, "_order", F.inline(F.array(
        F.struct(F.lit(True).alias(column), F.col("_taken").alias("_times")),
        F.struct(F.lit(False).alias(column), (F.col("_copies") - F.col("_taken")).alias("_times")))))
    return repeat_rows(parts.filter("_times > 0"), "_times", "_order").select(*columns, column)


def repeat_rows(df, times, spread_by):
    """Each row ``times`` times, in blocks spread over the tasks."""
    blocks = df.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(`{times}` - 1) div {COPIES_PER_TASK}"))))
    size = F.least(F.lit(COPIES_PER_TASK).cast("bigint"),
                   F.col(times) - F.col("_block") * COPIES_PER_TASK)
    # A fixed number of partitions: adaptive execution would merge the blocks by
    # their bytes, which are few until the rows are repeated.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (blocks.repartition(tasks, spread_by, "_block")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
            .drop("_block", "_copy", times))


def test_quota(size, share=TEST_SHARE):
    """``ceil(share * n)`` rows; a class of one row stays in the training part."""
    return F.when(size > 1, F.ceil(size * F.lit(float(share)))).otherwise(F.lit(0))


def stratified_split(df, label=LABEL, share=TEST_SHARE, keys=None, seed=SEED):
    """Column ``split``: ``test`` for the share of every class, else ``train``."""
    flagged = choose(df, label, lambda n: test_quota(n, share), keys, seed, column="_test")
    return flagged.select(*quoted(df), F.when(F.col("_test"), "test").otherwise("train").alias("split"))


def take_quota(df, quota, label=LABEL, keys=None, seed=SEED):
    """Exactly the quota of each class; see ``choose``."""
    return choose(df, label, quota, keys, seed).filter("chosen").drop("chosen")


def cap_classes(df, label=LABEL, cap=CLASS_CAP, keys=None, seed=SEED):
    """At most ``cap`` rows per class."""
    return take_quota(df, lambda n: F.least(n, F.lit(cap)), label, keys, seed)


def undersample(df, label=LABEL, target=TARGET_PER_CLASS, classes=(MAJORITY,), keys=None, seed=SEED):
    """Cut the named classes to ``target`` rows; the others pass unchanged."""
    cut = df.filter(F.col(label).isin(*classes))
    rest = df.filter(~F.coalesce(F.col(label).isin(*classes), F.lit(False)))
    return cap_classes(cut, label, target, keys, seed).unionByName(rest)


def class_sizes(df, label=LABEL):
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def small_classes(df, labels=None, label=LABEL, least=10):
    """Size and state of every class: ``empty``, ``few`` or ``ok``."""
    sizes = class_sizes(df, label)
    if labels is not None:
        sizes = labels.select(label).join(sizes, label, "left").fillna(0, subset=["n"])
    state = F.when(F.col("n") == 0, "empty").when(F.col("n") < least, "few").otherwise("ok")
    return sizes.select(label, "n", state.alias("state"))


def shuffle_rows(df, keys=None, seed=SEED):
    """Spread the rows over the tasks in hash order.

    A table has no row order to shuffle; what an iterative fit needs is that no
    task holds one class or one time range. Hash repartitioning gives that, and
    the sort inside each partition mixes the classes.
    """
    return (df.withColumn("_order", shuffle_key(df.columns, keys, seed))
            .repartition("_order").sortWithinPartitions("_order").drop("_order"))
