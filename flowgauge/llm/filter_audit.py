"""What each filter of a chain removes, wherever it stands in the chain.

Every filter is a stored table of the ids of the rows that fail it. Rows that fail the
same filters are never told apart by any order of them, so the id tables are joined once
with the rows, and what is left is a table of classes: at most one per part and set of
failed filters, with counts of rows and labels. All orders are then worked out on the
classes by anti and semi joins: survivors of a prefix are the classes without a failing
class of one of its filters, a step removes the survivors that fail its filter, and what
fails a filter but has not survived the prefix is redundant.
"""

from itertools import combinations, permutations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgauge.functions.small import local_table
from flowgauge.llm.shared import pick
from flowgauge.session import stored

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 200


def conditions(text):
    """The failure conditions that a text alone decides, by filter."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _marked(docs):
    """Stored rows, numbered: row, doc_id, part, digest and the flags A to D."""
    plain = pick(docs, "doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    made = plain.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(n) for n, c in conditions(F.col("text")).items()])
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "marked")


def failing_ids(marked):
    """One stored table (row, doc_id) per filter. E holds the rows whose text is that of a
    smaller id anywhere: all rows but those with the smallest id of their text. A row
    without an id is no copy, nor is anything a copy of it."""
    tables = {n: marked.filter(n).select("row", "doc_id") for n in "ABCD"}
    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    tables["E"] = marked.filter("doc_id is not null").join(firsts, ["doc_id", "digest"], "left_anti").select("row", "doc_id")
    return {n: stored(t, f"fails-{n}") for n, t in tables.items()}


def classes(marked, fails, labels):
    """Stored table (part, failed, n, good, toxic): rows by the filters they fail, a string
    of their letters. A row is good or toxic if any label row of its id says so.

    Each id table is met by a semi join that keeps every row and says whether it was met."""
    marks = pick(labels, "doc_id", "quality", "toxic")
    tables = {"good": marks.filter("quality = 1").select("doc_id"), "toxic": marks.filter("toxic = 1").select("doc_id"),
              **{n: t.select("row") for n, t in fails.items()}}
    # Names that no id table has, so that the condition cannot mean a column of its own.
    rows = marked.select("part", F.col("row").alias("audited_row"), F.col("doc_id").alias("audited_doc_id"))
    for name, ids in tables.items():
        key = ids.columns[0]
        rows = rows.withColumn(name, ids.where(F.col(key) == F.col(f"audited_{key}").outer()).exists())
    failed = F.concat(*[F.when(F.col(n), n).otherwise("") for n in fails])
    return stored(rows.groupBy("part", failed.alias("failed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")), "classes")


def _orders(spark, filters):
    """filter_order, step, filter and the prefix before it, as the sorted letters; every
    filter's steps; every prefix's filters."""
    rows = [("".join(o), k + 1, f, "".join(sorted(o[:k]))) for o in permutations(filters) for k, f in enumerate(o)]
    names = ("filter_order", "step", "filter", "prefix")
    orders = local_table(spark, dict(zip(names, map(list, zip(*rows)))), "filter_order string, step int, filter string, prefix string")
    steps = sorted({(p, f) for _, _, f, p in rows})
    members = [(p, m) for p in sorted({p for p, _ in steps}) for m in p]
    return (orders,
            local_table(spark, dict(zip(("prefix", "filter"), map(list, zip(*steps)))), "prefix string, filter string"),
            local_table(spark, dict(zip(("prefix", "filter"), map(list, zip(*members)))), "prefix string, filter string"))


def interactions(found, filters):
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, from the table of ``classes``."""
    spark = found.sparkSession
    orders, steps, members = _orders(spark, filters)
    one = ["part", "failed"]
    fails = found.withColumn("filter", F.explode(F.split("failed", "(?<=.)(?=.)"))).filter("filter <> ''")
    prefixes = ["".join(c) for k in range(len(filters)) for c in combinations(sorted(filters), k)]
    candidates = found.withColumn("prefix", F.explode(F.array(*map(F.lit, prefixes))))
    gone = fails.select(*one, "filter").join(members, "filter").select(*one, "prefix")
    survivors = candidates.join(gone, [*one, "prefix"], "left_anti")
    reached = survivors.join(steps, "prefix")
    failing = fails.select(*one, "filter")
    removed = reached.join(failing, [*one, "filter"], "left_semi")
    kept = reached.join(failing, [*one, "filter"], "left_anti")
    redundant = fails.join(steps, "filter").join(survivors, [*one, "prefix"], "left_anti")
    measures = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]

    def measured(rows, **values):
        return rows.select("part", "prefix", "filter", *[values.get(m, F.lit(0)).cast("long").alias(m) for m in measures])

    counted = (measured(kept, kept=F.col("n"))
               .unionByName(measured(removed, removed=F.col("n"), good_lost=F.col("good"), toxic_lost=F.col("toxic")))
               .unionByName(measured(redundant, redundant=F.col("n")))
               .groupBy("part", "prefix", "filter").agg(*[F.sum(m).alias(m) for m in measures]))
    # Of the orders of m filters, k! (m - 1 - k)! have a given prefix of k before a filter.
    share = F.expr(f"factorial(length(prefix)) * factorial({len(filters) - 1} - length(prefix))")
    alone = F.when(F.length("prefix") == len(filters) - 1, F.col("removed"))
    every = found.select("part").distinct().withColumn("step_of", F.explode(F.array(
        *[F.struct(F.lit(p).alias("prefix"), F.lit(f).alias("filter")) for p in prefixes for f in filters if f not in p]))).select("part", "step_of.*")
    of_filter = W.partitionBy("part", "filter")
    table = every.join(counted, ["part", "prefix", "filter"], "left").withColumns({
        "shapley": F.sum(F.col("removed") * share).over(of_filter), "unique_fails": F.sum(alone).over(of_filter)})
    return (table.join(orders, ["prefix", "filter"])
            .select("part", "filter_order", "step", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in [
                "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]]))


def audit(docs, labels):
    """One row per part (the source; a null one counts as an empty string), filter_order
    and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty. Repeated rows count each; of rows with equal ids and
    texts none is a copy of the other. A null id has no label. Labels of unknown ids
    change nothing. Empty documents give no rows, empty labels no losses. Other columns
    are not read."""
    marked = _marked(docs)
    fails = failing_ids(marked)
    return interactions(classes(marked, fails, labels), list(fails))
