"""Importance resampling of documents towards a target text collection.

Features are words and runs of words, hashed to buckets by CRC-32. The distinct feature
strings of a block of text are grouped by length into byte matrices; all checksums of a
matrix are updated column by column, and the buckets are scattered back to the features'
occurrences. A bucket's gain tells how much more frequent it is in the target than in the
documents; a document's weight is the mean gain of its features, and the highest weights
with random noise added are drawn.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from flowgauge.functions.running import running_totals
from flowgauge.llm.shared import add_columns, pick
from flowgauge.session import stored

BUCKETS = 10_000
RUN = 2                 # features are runs of one to so many words
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK = 1 << 21         # bytes of text that are worked on at a time
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Bytes of words: 0-9, a-z and all beyond ASCII. What parts words is ASCII alone, so that
# words of bytes are words of code points.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table():
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def _bytes_and_offsets(strings):
    """The buffers of an Arrow binary array as numpy arrays."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(strings) + 1 + strings.offset)[strings.offset:]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def checksums(strings):
    """The CRC-32 of every string of a large binary array, without nulls.

    Strings of equal length make a matrix. A matrix of fewer rows than columns would take
    more steps than it has rows; its rows are checked one by one."""
    data, offsets = _bytes_and_offsets(strings)
    sizes = np.diff(offsets)
    out = np.zeros(len(strings), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, firsts = np.unique(sizes[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, firsts[1:])):
        if len(rows) < length:
            out[rows] = [zlib.crc32(data[a:a + length]) for a in offsets[rows].tolist()]
            continue
        matrix = data[offsets[rows][None, :] + np.arange(length)[:, None]]       # a line for each column of bytes
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


def _words(data):
    """Begins and sizes of the words in an array of bytes."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def features(data, owner_starts, fresh, run=RUN, buckets=BUCKETS):
    """(bucket, owner) of every feature occurrence in a block of lower-cased bytes, single
    words first, and the number of those.

    ``owner_starts`` are the begins of the block's texts, which end in a byte outside
    words. The first ``fresh`` words of the block have been seen in the block before
    (the end of a text that goes on): features that lie within them are left out."""
    begins, sizes = _words(data)
    owner = np.searchsorted(owner_starts, begins, "right") - 1
    kept = IN_WORD[data]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(data[kept])])
    coded = words.dictionary_encode()
    code, listed = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    found, owners = [], []
    for n in range(1, run + 1):
        if n > 1:       # one word more: pairs of a run's code and the next word's code
            whole = owner[n - 1:] == owner[:len(owner) - n + 1]
            pair = codes[:-1][:len(whole)] * np.int64(len(coded.dictionary)) + code[n - 1:]
            distinct, codes = np.unique(pair, return_inverse=True)
            listed = pc.binary_join_element_wise(listed.take(pa.array(distinct // len(coded.dictionary))),
                                                 coded.dictionary.take(pa.array(distinct % len(coded.dictionary))), pa.scalar(b" ", pa.large_binary()))
        else:
            whole, codes = np.ones(len(code), bool), code
        bucket = (checksums(listed) % np.uint32(buckets)).astype(np.int64)
        at = np.flatnonzero(whole)
        at = at[at + n > fresh]
        found.append(bucket[codes[at]])
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners), len(found[0])


def _cut(data, at, run):
    """Where the block from ``at`` ends, and where its last ``run - 1`` words begin: a cut
    falls behind a word, and the block grows while it has no such place."""
    size = BLOCK
    while at + size < len(data):
        block = np.frombuffer(data, np.uint8, size, at)
        outside = np.flatnonzero(~IN_WORD[block])
        if len(outside):
            begins, _ = _words(block[:outside[-1] + 1])
            if len(begins) > run:
                return at + int(outside[-1]) + 1, at + int(begins[len(begins) - run + 1]) if run > 1 else at + int(outside[-1]) + 1
        size *= 2
    return len(data), len(data)


def blocks(texts, run=RUN):
    """(first text, data, begins of texts, words seen before) of blocks of about ``BLOCK``
    bytes: many short texts, or a part of one long text. ``texts`` are bytes or None."""
    held, begins, size, first = [], [], 0, 0
    for i, text in enumerate(texts):
        data = (text or b"").translate(UPPER) + b" "
        if size and size + len(data) > BLOCK:
            yield first, np.frombuffer(b"".join(held), np.uint8), np.array(begins), 0
            held, begins, size = [], [], 0
        if len(data) > BLOCK:
            at, seen = 0, 0
            while at < len(data):
                end, again = _cut(data, at, run)
                yield i, np.frombuffer(data, np.uint8, end - at, at), np.zeros(1, np.int64), seen
                at, seen = (end, 0) if end == len(data) else (again, run - 1)
            continue
        if not held:
            first = i
        held.append(data)
        begins.append(size)
        size += len(data)
    if held:
        yield first, np.frombuffer(b"".join(held), np.uint8), np.array(begins), 0


def bucket_counts(texts, run=RUN, buckets=BUCKETS):
    """bucket, n: how many feature occurrences of a table with a binary column ``text``
    fall into each bucket. A task returns one row per bucket that it met."""
    def run_task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, begins, seen in blocks((t.as_py() for t in batch.column(0)), run):
                found, _, _ = features(data, begins, seen, run, buckets)
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run_task, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts, buckets):
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():        # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(own, target, buckets=BUCKETS):
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket."""
    s_all, t_all = float(own.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weighed(docs, gain, run=RUN):
    """Adds n_features, n_words and weight to rows with a binary ``text``, from each bucket's gain."""
    at = docs.columns.index("text")

    def add(batch):
        column = batch.column(at)
        n, words, total = (np.zeros(len(column), np.int64) for _ in range(3))
        for first, data, begins, seen in blocks((t.as_py() for t in column), run):
            bucket, owner, single = features(data, begins, seen, run, len(gain))
            np.add.at(total, first + owner, gain[bucket])
            n += np.bincount(first + owner, minlength=len(n))
            words += np.bincount(first + owner[:single], minlength=len(n))
        return [pa.array(n), pa.array(words), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

    return add_columns(docs, add, "n_features long, n_words long, weight long")


def resample(docs, target, run=RUN, buckets=BUCKETS, least_words=LEAST_WORDS, percent=PERCENT, seed=SEED):
    """One row per document: doc_id, n_features, weight, score and rank (null: not drawn).

    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn by
    score: the weight and noise made from the id. Ties go to the smaller id, null ids
    last; the noise of a null id is that of the text ``null``. A null or empty text has no
    feature and weight 0, as has a text of separators. Rows with equal ids and texts are
    ranked each, one after the other. Without target texts every bucket's target count is
    0; an empty table gives no rows. Other columns are not read."""
    plain = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    wanted = pick(target, "text").withColumn("text", F.col("text").cast("binary"))
    gain = gains(_as_array(bucket_counts(plain, run, buckets), buckets), _as_array(bucket_counts(wanted, run, buckets), buckets), buckets)
    rows = weighed(plain, gain, run).drop("text")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    scored = rows.withColumns({"score": F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))).cast("long"),
                               "enough": (F.col("n_words") >= least_words).cast("int")})
    scored = stored(scored.drop("n_words").withColumns({
        "_down": -F.col("score"), "_none": F.col("doc_id").isNull()}), "scored")
    most = (scored.agg(F.sum("enough")).first()[0] or 0) * percent // 100
    placed = running_totals(scored, [], [F.desc("enough"), "_down", "_none", "doc_id"], "enough", "_before", "drawn")
    rank = F.when((F.col("enough") == 1) & (F.col("_before") < most), F.col("_before") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
