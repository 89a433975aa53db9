"""Mixing sources to target weights.

Each source gets a target from its weight; documents of a source are range-sorted by a
hash-random key, distributed prefix sums of their word counts are computed, and the cut
falls at the source's exact budget. A budget of more than the source repeats it whole
before the cut.
"""

from pyspark.sql import functions as F

from flowgauge.functions.running import running_totals
from flowgauge.llm.shared import pick, positions
from flowgauge.session import stored

WEIGHTS = (1, 2, 3)
EPOCHS = 3              # a target stops at this many times its source
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def _size(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows, weights=WEIGHTS, epochs=EPOCHS):
    """has_source, source_key, source_size, target, from rows with the keys and size.

    Weights go round in the sources' code point order, null last. Sources share the
    sum of all sizes by weight; what is above ``epochs`` times a source is shared anew
    among the rest, by their weight, until none is above. Each round is one aggregate
    of the source table that returns a single row."""
    sizes = rows.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(sizes.withColumn("_one", F.lit(1)), [], ["no_source", "source_key"], "_one", "_rank", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("no_source", "source_key", "source_size", weight.cast("double").alias("weight"),
                                   (F.col("source_size") * float(epochs)).alias("most")), "sources")
    level, before = 0.0, -1.0
    while level > before:
        free = F.col("most") > F.col("weight") * F.lit(level)
        total, held, shared = sources.agg(
            F.sum("source_size"), F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        before = level
        if shared:
            level = max(level, ((total or 0) - (held or 0.0)) / shared)
    return sources.select("no_source", "source_key", "source_size",
                          F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def _taken(rows, weights, epochs, seed):
    """Rows with source_size, target, and taken: the words the mix takes of each."""
    sources = targets(rows, weights, epochs)
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    placed = running_totals(drawn, ["no_source", "source_key"], ["draw", "doc_id", "print", "size"], "size", "before", "drawn")
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size")
    cut = F.least("size", F.greatest(F.lit(0), rest - F.col("before")))
    return placed.join(sources, ["no_source", "source_key"]).withColumn("taken", passes * F.col("size") + cut)


def _keyed(docs, doc_id, source, text, text_print):
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source_key"), _size(F.col(text)).alias("size"), text_print.alias("print"))


def mix(docs, weights=WEIGHTS, epochs=EPOCHS, seed=SEED):
    """One row per document: doc_id, size, source_size, target, taken.

    A null text has no words; null sources are one source. Rows that tie in the random
    order are alike in id and text, so which of them the cut meets first says nothing.
    A table without words takes none; an empty one gives none."""
    plain = pick(docs, "doc_id", "source", "text")
    rows = stored(_keyed(plain, "doc_id", "source", "text", F.xxhash64("text")), "sizes")
    return _taken(rows, weights, epochs, seed).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs, weights=WEIGHTS, epochs=EPOCHS, seed=SEED):
    """The mix itself: each document as often as it is taken, the one that a source's
    budget cuts shortened to the words taken (``n_chars`` follows, if there). Rows equal
    in id, source and text are taken as copies of one of them."""
    plain, at = positions(docs, "doc_id", "source", "text")
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    prints = {"k0": F.col(at["doc_id"]).isNull(), "k1": F.coalesce(F.col(at["doc_id"]), F.lit(0)),
              "k2": F.col(at["source"]).isNull(), "k3": F.coalesce(F.col(at["source"]), F.lit("")), "k4": F.xxhash64(text)}
    rows = stored(_keyed(plain, at["doc_id"], at["source"], at["text"], prints["k4"]), "sizes")
    chosen = _taken(rows, weights, epochs, seed).filter("taken > 0").groupBy(
        F.col("doc_id").isNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"),
        F.col("no_source").alias("k2"), F.col("source_key").alias("k3"), F.col("print").alias("k4")
    ).agg(F.first("size").alias("size"), F.sum("taken").cast("long").alias("taken"))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = (plain.withColumns(prints).join(stored(chosen, "chosen"), list(prints)).dropDuplicates(list(prints))
           .withColumn("words", F.explode(copies)))
    start = F.regexp_replace(at["text"], r"^[\x20\x09-\x0D]+", "")
    short = F.concat_ws("", F.slice(F.split(start, GAP), F.lit(1), F.greatest("words", F.lit(1))))
    changed = {at["text"]: F.when(F.col("words") > 0, short).otherwise(F.col(at["text"]))}
    if "n_chars" in docs.columns:
        n = plain.columns[docs.columns.index("n_chars")]
        kind = plain.schema[n].dataType
        changed[n] = F.when(F.col("words") > 0, F.length(short).cast(kind)).otherwise(F.col(n))
    return out.withColumns(changed).select(*plain.columns).toDF(*docs.columns)
