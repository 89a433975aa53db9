"""Homomorphic multiset fingerprints of documents.

A fingerprint is a sum of vectors hashed from a document's paragraphs, so it does not
depend on their order, and a paragraph is put in or taken out by adding or subtracting
its vector. Eight lanes modulo 2**32 carry equality. Beside them, 64 lanes of 31
bits count, for each bit of a 64-bit hash, the clauses of the paragraphs that have it set:
the difference of two such vectors tells how much of the two multisets differs, which
gives the likeness of two fingerprints without their texts.

Everything is built-in functions; no Python runs on the executors.
"""

from pyspark.sql import functions as F

from flowgauge.functions.running import running_totals
from flowgauge.llm.shared import pick
from flowgauge.session import stored

WIDE = 4                        # 64-bit hashes of a paragraph, two lanes each
LANES = 32                      # a bit of a clause hash shares a long with the one so far above
MOST = (1 << 31) - 1            # clauses that a lane holds; no text has more, as strings end there
SPREAD = 1 | 1 << LANES
CLAUSE = r"\n|(?<=[.!?,;:|%$#*&)])[ \t]+"


def _lane(paragraphs, half, seed):
    total = F.aggregate(paragraphs, F.lit(0).cast("long"), lambda acc, p: acc + half(F.xxhash64(p, F.lit(seed))))
    return total.bitwiseAND(F.lit(0xFFFFFFFF))


def paragraph_lanes(paragraphs):
    """Eight sums modulo 2**32 over an array of paragraphs."""
    halves = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))
    return [_lane(paragraphs, half, seed) for seed in range(WIDE) for half in halves]


def fingerprints(texts, *keys):
    """keys, units, wide (eight lanes), counts (32 longs of two lanes), per row of
    ``texts`` (keys, text)."""
    wide = [f"w{i}" for i in range(2 * WIDE)]
    # The lanes come first: beside the explode they would be worked out for every clause.
    laned = texts.select(*keys, "text", *[lane.alias(w) for w, lane in zip(wide, paragraph_lanes(F.split("text", "\n")))])
    split = laned.select(*keys, *wide, F.explode(F.split("text", CLAUSE)).alias("unit"))
    hashed = split.select(*keys, *wide, F.xxhash64("unit").alias("hash"))
    bits = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(SPREAD))).alias(f"s{k}") for k in range(LANES)]
    summed = hashed.groupBy(*keys, *wide).agg(F.count(F.lit(1)).alias("units"), *bits)
    return summed.select(*keys, "units", F.array(*wide).alias("wide"), F.array(*[f"s{k}" for k in range(LANES)]).alias("counts"))


def combined(a, b, sign=1):
    """The fingerprint columns of two multisets put together, or, with ``sign`` -1, of
    the first without the second. More clauses than the lanes hold are an error."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    counts = F.zip_with(a["counts"], b["counts"], lambda x, y: x + sign * y)
    units = a["units"] + sign * b["units"]
    held = F.when(units > MOST, F.raise_error(F.lit("more clauses than a fingerprint's lanes hold")).cast("array<bigint>")).otherwise(counts)
    return F.struct(units.alias("units"), wide.alias("wide"), held.alias("counts"))


def as_text(units, wide, counts):
    """A fingerprint as hex: the wide lanes, the clauses, the counts."""
    hexed = lambda array, digits: F.array_join(F.transform(array, lambda x: F.lower(F.lpad(F.hex(x), digits, "0"))), "")
    return F.concat(hexed(wide, 8), F.lit("-"), F.lower(F.hex(units)), F.lit("-"), F.coalesce(hexed(counts, 16), F.lit("")))


def _lanes(counts, units):
    """Set bits less clear ones, of each lane."""
    half = [F.transform(counts, lane) for lane in (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), lambda x: F.shiftrightunsigned(x, LANES))]
    return F.transform(F.concat(*half), lambda x: 2 * x - units)


def _square(lanes):
    return F.aggregate(lanes, F.lit(0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def likeness(a, b):
    """1 for equal multisets, 0 for such as share nothing: one less the squared
    difference over the sum of the squares, as the lanes estimate them."""
    x, y = _lanes(a["counts"], a["units"]), _lanes(b["counts"], b["units"])
    apart = _square(F.zip_with(x, y, lambda p, q: p - q)) / (_square(x) + _square(y))
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(1 - apart, F.lit(0.0))))


KEY = ["has_id", "id", "h", "g"]


def _neighbours(docs):
    """For every different document, by id and text hashes: its copies, and the key of
    the one before it in descending order of ids, with the characters that one asks of
    it. Also whether any document has copies."""
    keys = docs.select(*KEY, F.length("text").alias("n")).groupBy(*KEY, "n").agg(F.count(F.lit(1)).alias("copies"))
    ranked = stored(running_totals(keys.withColumn("_one", F.lit(1)), [], KEY, "_one", "rank", "keys").drop("_one"), "ranked")
    total, most = ranked.agg(F.count(F.lit(1)), F.max("copies")).first()
    askers = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"),
                           *[F.col(k).alias(f"to_{k}") for k in KEY], F.floor(F.col("n") / 2).cast("int").alias("asked"))
    return stored(ranked.select(*KEY, "copies", "rank").join(askers, "rank").drop("rank"), "asks"), (most or 0) > 1


def fingerprinted(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every document.

    The edited text is the text with its last half replaced by as much of the start of
    the next document in descending order of doc_id (null ids last, the first after the
    last; equal ids by their text's hash). A null text is empty. Rows equal in id and
    text are one document here, whose result is given once per row. The only document
    of a table is its own next one; an empty table gives none.

    Texts move once, to where their key is; the start that another text asks for moves
    on to that one's key, and sums of a key stay where they are."""
    text = F.coalesce("text", F.lit(""))
    plain = pick(docs, "doc_id", "text")
    id_type = plain.schema["doc_id"].dataType
    plain = plain.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), text.alias("text"))
    plain = plain.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64("text", F.lit(1))})
    asks, repeated = _neighbours(plain)
    to = [F.col(f"to_{k}").alias(k) for k in KEY]
    placed = plain.join(asks.drop("copies"), KEY)
    if repeated:
        placed = placed.dropDuplicates(KEY)
    half = F.floor(F.length("text") / 2).cast("int")
    heads = placed.select(*KEY, F.length("text").alias("n"), F.substring("text", F.lit(1), F.length("text") - half).alias("head"))
    tails = placed.select(*to, F.substring("text", F.lit(1), F.col("asked")).alias("tail"))
    edited = heads.join(tails, KEY).select(*KEY, "n", F.concat("head", "tail").alias("text"))

    fields = F.struct("units", "wide", "counts")
    own = stored(fingerprints(placed if repeated else plain, *KEY).select(*KEY, fields.alias("f")), "prints")
    changed = fingerprints(edited.withColumn("sha", F.sha2("text", 256)), *KEY, "n", "sha").select(
        *KEY, "n", F.col("sha").alias("edited_sha256"), fields.alias("e"))
    nexts = own.join(asks, KEY).select(*to, F.col("f").alias("x"))
    rows = changed.join(own, KEY).join(nexts, KEY)
    if repeated:
        rows = rows.join(asks.select(*KEY, "copies"), KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    written = lambda c: as_text(F.col(c)["units"], F.col(c)["wide"], F.col(c)["counts"])
    return rows.select(
        F.when(F.col("has_id"), F.col("id")).cast(id_type).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        written("f").alias("fingerprint"), written("e").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("x")).alias("near_next"))
