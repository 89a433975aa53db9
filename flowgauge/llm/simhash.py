"""SimHash near-duplicates, found with pivot distance tables.

A fingerprint is placed by its Hamming distances to reference fingerprints (pivots).
Two fingerprints within ``k`` bits differ by at most ``k`` in every such distance, so
a larger difference in any coordinate discards a pair unseen; survivors are verified.

Pairs come from the table itself. The zero fingerprint and the 64 one-bit ones are
pivots too: the distance to pivot j less the distance to zero tells bit j. Cut into
``k + 3`` blocks of such coordinates, fingerprints within ``k`` bits agree on at least
three blocks, so each choice of three blocks is one table whose equal rows are
candidates, and nothing else is ever compared. Only distinct fingerprints take part:
copies meet in an aggregate beforehand. Within a group of candidates a search outward
from one member after another returns a spanning set of links, never all pairs; a large
group is cut into pieces that are searched two by two, so that no task holds it.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from flowgauge.llm.graph import components
from flowgauge.llm.shared import add_columns, pick, positions
from flowgauge.session import stored

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PIVOTS = 16             # reference fingerprints beside the 65 that tell the bits
GROUP = 4096            # members of a candidate group that one task searches
CHUNK = 1 << 16         # shingles whose bits are counted at a time


def fingerprint(text, shingle=SHINGLE):
    """64 bits as a signed long; 0 for a text without a word."""
    words = text.encode("utf-8", "replace").lower().split()     # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    counts = np.zeros(64, np.int64)
    for start in range(0, len(grams), CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[start:start + CHUNK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<i8")[0])


def with_fingerprint(docs, text, into="print", shingle=SHINGLE):
    at = docs.columns.index(text)

    def make(batch):
        return [pa.array([fingerprint(t or "", shingle) for t in batch.column(at).to_pylist()], pa.int64())]
    return add_columns(docs, make, f"{into} long")


def pivots(count=PIVOTS):
    """Reference fingerprints, fixed by their number alone."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(count)], np.uint64)


def masks(max_bits):
    """For each choice of three of ``max_bits + 3`` blocks, the bits it looks at."""
    edges = np.linspace(0, 64, max_bits + 4).round().astype(int)
    blocks = [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]
    signed = [sum(chosen) for chosen in combinations(blocks, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in signed]


def spanning_links(prints, max_bits, references):
    """Links that join whatever is joined by pairs within ``max_bits``; at most one
    per member. Rows are kept in the order of their distance to the first pivot."""
    prints = np.sort(prints.view(np.uint64))
    table = np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    links, waiting = [], np.ones(len(prints), bool)
    for seed in range(len(prints)):
        if not waiting[seed]:
            continue
        waiting[seed], reached = False, [seed]
        while reached:
            at = reached.pop()
            low = np.searchsorted(table[:, 0], table[at, 0] - max_bits, "left")
            high = np.searchsorted(table[:, 0], table[at, 0] + max_bits, "right")
            near = low + np.flatnonzero(waiting[low:high])
            near = near[np.abs(table[near] - table[at]).max(1, initial=0) <= max_bits]
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= max_bits]
            waiting[near] = False
            links += [(at, int(i)) for i in near]
            reached += near.tolist()
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return prints[pairs[:, 0]].view(np.int64), prints[pairs[:, 1]].view(np.int64)


def near_links(prints, max_bits=MAX_BITS, group=GROUP):
    """Links (a, b) between distinct fingerprints of column ``print`` whose components
    are those of all pairs within ``max_bits`` bits."""
    references = pivots()
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key"))
                               for i, m in enumerate(masks(max_bits))])).alias("cell")
    cells = prints.select("print", rows).select("print", "cell.t", "cell.key")
    shared = stored(cells.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b")).filter("n > 1"), "cells")
    two = shared.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    many = cells.join(shared.filter("n > 2").select("t", "key", "n"), ["t", "key"])
    pieces = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("print"), pieces).cast("int")
    # Every two pieces of a group meet in one task; a group of one piece is its own.
    meet = (many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
            .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print"))

    def search(frame):
        a, b = spanning_links(frame["print"].to_numpy(np.int64).copy(), max_bits, references)
        return pd.DataFrame({"a": a, "b": b})

    return two.union(meet.groupBy("t", "key", "i", "j").applyInPandas(search, "a long, b long"))


def _classes(rows):
    """``first`` (the smallest document) of the component of every ``print``."""
    prints = stored(rows.groupBy("print").agg(F.min("first").alias("first")), "prints")
    roots = components(near_links(prints)).withColumnRenamed("node", "print")
    placed = stored(prints.join(roots, "print", "left")
                    .select("print", "first", F.coalesce("root", "print").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return placed.join(least, "root").select("print", "least")


def near_duplicates(docs):
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    A null or wordless text has fingerprint zero and links like any other. Null ids
    never name a component unless it has no other; repeated rows repeat their result;
    an empty table gives none."""
    rows = stored(with_fingerprint(pick(docs, "doc_id", "text"), "text").select("doc_id", "print"), "rows")
    classes = _classes(rows.select("print", F.col("doc_id").alias("first")))
    return rows.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs):
    """One document of each component, the one with the smallest id (a null id comes
    last; of rows equal in id and text any one), with all its columns."""
    plain, at = positions(docs, "doc_id", "text")
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    keys = {"k0": F.col(at["doc_id"]).isNull(), "k1": F.coalesce(F.col(at["doc_id"]), F.lit(0)),
            "k2": F.xxhash64(text), "k3": F.xxhash64(text, F.lit(1))}
    rows = stored(with_fingerprint(plain.select(at["text"], *[c.alias(k) for k, c in keys.items()]), at["text"])
                  .select("print", *keys), "rows")
    classes = _classes(rows.select("print", F.struct(*keys).alias("first")))
    chosen = stored(classes.select("least").distinct().select("least.*"), "chosen")
    return (plain.withColumns(keys).join(chosen, list(keys)).dropDuplicates(list(keys))
            .select(*plain.columns).toDF(*docs.columns))
