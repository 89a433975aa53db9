"""Repeated substrings by a distributed difference-cover suffix sort.

Which bytes does a string of ``LENGTH`` bytes cover that starts anywhere else too?
Suffixes are sorted by the difference cover modulo 3: suffixes at positions 1 and 2
modulo 3 are sorted by triples, named, and the sort recurses on the names until they
tell apart ``LENGTH`` bytes; the suffixes at positions 0 are sorted by one byte and the
name behind it and merged in; then neighbours are compared over the whole prefix.

The sort is dealt out so that equal strings meet. Content decides: the smallest hash of
the ``GRAM``-byte strings in a window marks its anchor, and equal windows have equal
anchors at equal places. Between one anchor and the next lies a cell: the windows that
share the later anchor, and their bytes. Three exact steps leave only little to sort:

* a window whose anchor occurs once in the corpus is not repeated;
* a cell that occurs twice, by a 128-bit hash, has all its windows repeated;
* of the other cells and one copy of each repeated cell with the same anchor, the bytes
  are dealt by anchor into parts, by a running total of bytes that bounds every part by
  twice ``PART``, and each part is suffix-sorted.

An anchor whose cells hold more bytes than a part should is not dealt into one; its cells
are cut into ever smaller blocks of windows, and told apart by hashes of what all windows
of a block share and of the whole, with map-side aggregates, which no hot anchor can skew.
"""

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.running import running_totals
from flowgauge.llm.shared import pick
from flowgauge.session import stored

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1        # grams in a window
PART = 1 << 18                  # bytes that one suffix sort takes, or up to twice as many
ROWS = 64                       # texts that are Python objects at a time
CHUNK = 1 << 18                 # bytes that are hashed together
HOT = 4096                      # cells of one anchor beyond which they are cut into blocks
BLOCKS = (43, 11, 3, 1)         # windows of a block, one cut after another; cores need 128 bytes
_RNG = np.random.default_rng(20)
CODE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)

CELL = "anchor long, cell long, h long, place long, first int, last int"


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def _slide(x, width, pick):
    """``pick`` (min or max) over every window of ``width``."""
    span = 1
    while span * 2 <= width:
        x, span = pick(x[:-span], x[span:]), span * 2
    return pick(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def gram_hashes(data):
    """Hashes of all strings of 32 and of 128 bytes."""
    h, span, power, short = CODE[data], 1, int(BASE), None
    while span < 128:
        h = h[:-span] * np.uint64(power) + h[span:]
        power, span = power * power % (1 << 64), span * 2
        if span == GRAM:
            short = h
    return short, h


def _least_places(order):
    """The leftmost smallest place of every window."""
    at, span = np.arange(len(order)), 1
    while span < SPAN:
        step = min(span, SPAN - span)
        left, right = at[:-step], at[step:]
        at = np.where(order[left] <= order[right], left, right)
        span += step
    return at


def _placed(order, long, marks, first, last):
    """Anchor and cell hashes of cells given by anchor and first and last window."""
    end = last + LENGTH
    middle = (first + end) // 2 - 64
    shape = (last - first + 1).astype(np.uint64) * BASE + (marks - first).astype(np.uint64)
    whole = _mixed(_mixed(_mixed(shape + long[first]) + long[middle]) + long[end - 128])
    return order[marks].view(np.int64), whole.view(np.int64), first, last


def cells(data):
    """Anchors of a text and their cells: (anchor hash, cell hash, first and last window
    start). A window's anchor is its leftmost smallest gram, so its bytes alone decide
    it; a cell is a run of windows with one anchor."""
    short, long = gram_hashes(data)
    order = _mixed(short)
    marks = _least_places(order)
    starts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    first = np.concatenate([[0], starts])
    last = np.concatenate([starts - 1, [len(data) - LENGTH]])
    return _placed(order, long, marks[first], first, last)


def cells_of_many(texts):
    """(text's number, anchor hash, cell hash, first, last) over texts of at least
    ``LENGTH`` bytes, worked out on all of them in one array: a run of windows with the
    same least value has the one gram of that value as its anchor. A text in which a
    window holds its least value twice is worked out alone."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    short, long = gram_hashes(data)
    order = _mixed(short)
    least = _slide(order, SPAN, np.minimum)
    windows = np.zeros(len(least) + 1, bool)            # starts of windows inside one text
    for low, high in zip(starts.tolist(), (ends - LENGTH + 1).tolist()):
        windows[low:high] = True
    least = np.where(windows[:-1], least, 0)
    edge = np.zeros(SPAN - 1, np.uint64)
    marks = np.flatnonzero((_slide(np.concatenate([edge, least, edge]), SPAN, np.maximum) == order) & (order > 0))
    change = np.concatenate([[True], least[1:] != least[:-1], [True]]) | np.isin(np.arange(len(least) + 1), starts)
    bounds = np.flatnonzero(change)
    first, last = bounds[:-1], bounds[1:] - 1
    inside = windows[first]
    first, last = first[inside], last[inside]
    of_first, of_mark = (np.searchsorted(ends, x, "right") for x in (first, marks))
    clear = np.bincount(of_first, minlength=len(texts)) == np.bincount(of_mark, minlength=len(texts))
    first, last, marks = first[clear[of_first]], last[clear[of_first]], marks[clear[of_mark]]
    number = of_first[clear[of_first]]
    anchor, whole, first, last = _placed(order, long, marks, first, last)
    parts = [(number, anchor, whole, first - starts[number], last - starts[number])]
    for i in np.flatnonzero(~clear):
        alone = cells(np.frombuffer(texts[i], np.uint8))
        parts.append((np.full(len(alone[0]), i), *alone))
    return [np.concatenate(column) for column in zip(*parts)]


def _rows(batch):
    """The rows of a batch as Python objects, few at a time."""
    for at in range(0, batch.num_rows, ROWS):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns))


def _chunks(rows, size):
    """Rows (..., bytes) in lists of at least ``size`` bytes in all."""
    chunk, held = [], 0
    for row in rows:
        chunk.append(row)
        held += len(row[-1])
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _cell_rows(docs):
    """One row per cell of every text (h, place) of at least ``LENGTH`` bytes."""
    def run(batches):
        for batch in batches:
            rows = ((h, g, t.encode("utf-8", "replace")) for h, g, t in _rows(batch))
            for chunk in _chunks((row for row in rows if len(row[2]) >= LENGTH), CHUNK):
                h, g, texts = zip(*chunk)
                number, anchor, whole, first, last = cells_of_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(whole), pa.array(np.array(h)[number]), pa.array(np.array(g)[number]),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=[f.split()[0] for f in CELL.split(", ")])

    return docs.filter(F.octet_length("text") >= LENGTH).select("h", "place", "text").mapInArrow(run, CELL)


def _joined(run, room=1 << 22):
    """Small batches put together, so that few cross to the JVM, of ``room`` bytes or little more."""
    def whole(batches):
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= room:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return whole


def _sorted_with_places(keys):
    """Sorted keys and where they were; ties in the order they had. Keys and places share
    one number where they fit, since numbers sort several times faster than places."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) < 1 << (63 - bits):
        both = np.sort((keys << bits) | np.arange(len(keys)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def dense(keys):
    """Names: the rank of each key among the different ones; and their number."""
    ordered, places = _sorted_with_places(keys)
    ranks = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(keys) else places
    names = np.empty(len(keys), np.int64)
    names[places] = ranks
    return names, int(ranks[-1]) + 1 if len(keys) else 0


def suffix_ranks(s, symbols, depth):
    """Places of the suffixes of ``s`` (names below ``symbols``) in sorted order, by the
    difference cover modulo 3. Suffixes alike in their first ``depth`` symbols stand
    together, in any order. The end counts as smallest."""
    n = len(s)
    if n < 4:
        place = np.empty(n, np.int64)
        place[sorted(range(n), key=lambda i: s[i:].tolist())] = np.arange(n)
        return place
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(4, np.int64)])
    base = symbols + 1
    zeros, ones, twos = (np.arange(k, n, 3) for k in range(3))
    sample = np.concatenate([ones, twos])
    pairs, paired = t[sample] * base + t[sample + 1], base * base
    if paired * base * 2 * n >= 1 << 63:
        pairs, paired = dense(pairs)
    names, different = dense(pairs * base + t[sample + 2])
    del pairs
    if different < len(sample) and depth > 3:
        # Names of the positions 1 modulo 3, an end, names of the positions 2 modulo 3.
        text = np.concatenate([names[:len(ones)] + 1, [0], names[len(ones):] + 1])
        names = np.delete(suffix_ranks(text, different + 1, -(-depth // 3)), len(ones))
        different = len(text)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1
    # What a suffix of each kind is compared by with those at positions 0: one symbol and
    # the name behind it, or two symbols and a name.
    size = different + 2
    first = t * size
    by_one = first[:n] + rank[1:n + 1]
    tails, tail_size = first[1:n + 1] + rank[2:n + 2], base * size
    if tail_size * base >= 1 << 63:
        both = np.concatenate([zeros, twos])
        tails[both], tail_size = dense(tails[both])
    by_two = t[:n] * tail_size + tails
    keys_of_zeros, order = _sorted_with_places(by_one[zeros])
    zeros = zeros[order]
    _, order = _sorted_with_places(rank[sample])
    merged = sample[order]
    is_one = merged % 3 == 1
    ones, twos = merged[is_one], merged[~is_one]
    place = np.empty(n, np.int64)
    place[merged] = np.arange(len(merged))
    place[ones] += np.searchsorted(keys_of_zeros, by_one[ones], "right")
    place[twos] += np.searchsorted(by_two[zeros], by_two[twos], "right")
    place[zeros] = (np.arange(len(zeros)) + np.searchsorted(by_one[ones], keys_of_zeros)
                    + np.searchsorted(by_two[twos], by_two[zeros]))
    return place


def repeated_windows(strings, length=LENGTH):
    """For each string, which of its windows of ``length`` bytes start elsewhere too."""
    text = np.frombuffer(b"".join(strings) + bytes(length), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - length + 1
    windows = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    ranks = suffix_ranks(text, 256, length)
    _, order = _sorted_with_places(ranks[windows])
    sorted_windows = windows[order]
    same = np.zeros(len(order) + 1, bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for low in range(0, len(order) - 1, 1 << 15):
        high = min(low + (1 << 15), len(order) - 1)
        same[low + 1:high + 1] = (view[sorted_windows[low:high]] == view[sorted_windows[low + 1:high + 1]]).all(1)
    out = np.zeros(len(order), bool)
    out[order] = same[:-1] | same[1:]
    return np.split(out, np.cumsum(counts)[:-1])


def _intervals(flags, first):
    """Runs of true flags as (first, last) window starts."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return (edges[::2] + first).tolist(), (edges[1::2] - 1 + first).tolist()


def _cells_in(batch):
    """The wanted cells of a batch of texts (h, place, part, anchor, first, last, done, data)."""
    for h, g, text, wanted in _rows(batch):
        data = text.encode("utf-8", "replace")
        for w in wanted:
            yield h, g, w["part"], w["anchor"], w["first"], w["last"], w["done"], data[w["first"]:w["last"] + LENGTH]


def _cut(wanted_texts):
    """The bytes of wanted cells: (h, place, part, anchor, first, last, done, data)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            for chunk in _chunks(_cells_in(batch), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)],
                                                 names=["h", "place", "part", "anchor", "first", "last", "done", "data"])

    return wanted_texts.mapInArrow(run, "h long, place long, part int, anchor long, first int, last int, done boolean, data binary")


def _sort_part(frame):
    out = []
    for h, g, first, flags in zip(frame["h"], frame["place"], frame["first"], repeated_windows(frame["data"].tolist())):
        out += [(h, g, a, b) for a, b in zip(*_intervals(flags, first))]
    return pd.DataFrame(out, columns=["h", "place", "a", "b"])


def _blocks(rows, size, cells):
    """The ``cells`` of each batch of ``rows`` cut wherever a window's place before its anchor goes into another ``size``.
    ``core`` hashes the bytes that all windows of such a block have, whether the cell has
    them or not, and ``whole`` the windows of this cell in it: equal windows have equal
    cores, and equal wholes have equal windows."""
    def run(batches):
        for batch in batches:
            for h, g, _, anchor, first, _, done, data in cells(batch):
                short, long = gram_hashes(np.frombuffer(data, np.uint8))
                # The leftmost least gram of the first window: that of every other one, too.
                mark = int(np.argmax(_mixed(short).view(np.int64) == anchor))
                n = len(data) - LENGTH + 1
                block = np.arange((mark - n + 1) // size, mark // size + 1)
                low, high = np.maximum(mark - block * size - size + 1, 0), np.minimum(mark - block * size, n - 1)
                start, end = mark - block * size, mark - block * size - size + 1 + LENGTH
                core = _mixed(_mixed(block.astype(np.uint64) * BASE + long[start]) + long[end - 128])
                whole = _mixed(_mixed(core + (mark - low).astype(np.uint64) * BASE + (high - low).astype(np.uint64) * MIX
                                      + long[low]) + long[high + LENGTH - 128])
                many = len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(many, x)) for x in (h, g, anchor)] + [pa.array(x.view(np.int64)) for x in (core, whole)]
                    + [pa.array((first + x).astype(np.int32)) for x in (low, high)]
                    + [pa.array([done] * many), pa.array([data[a:b + LENGTH] for a, b in zip(low.tolist(), high.tolist())], pa.binary())],
                    names=["h", "place", "anchor", "core", "whole", "first", "last", "done", "data"])

    return rows.mapInArrow(_joined(run), "h long, place long, anchor long, core long, whole long, first int, last int, done boolean, data binary")


def _hot_runs(rows):
    """Runs of windows of hot anchors that occur twice, by a hash of 128 bits with the
    anchor's. The wanted cells of texts (``done`` when all their windows are known to) are
    cut into ever smaller blocks of windows. A block whose core nothing shares is left, one
    that occurs whole elsewhere is repeated, and only the others are cut again: a cell's
    rows follow its runs, not its windows. Texts are cut into cells by the same Python
    function as these into blocks: two of them in a row would hold two workers a task."""
    found, cells = [], _cells_in
    for size in BLOCKS:
        blocks = stored(_blocks(rows, size, cells), "blocks")
        one = [F.first(c).alias(c) for c in ("h", "place", "first", "last", "data")]
        kinds = stored(blocks.groupBy("anchor", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("done").alias("done"), *one), "wholes")
        twice = kinds.filter("n > 1").select("anchor", "core", "whole")
        found.append(blocks.filter("not done").join(twice, ["anchor", "core", "whole"]).select(
            "h", "place", F.col("first").alias("a"), F.col("last").alias("b")))
        kinds = kinds.withColumn("done", F.col("done") | (F.col("n") > 1))
        shared = kinds.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("m"), F.min("done").alias("settled")).filter("m > 1 and not settled")
        rows = kinds.join(stored(shared.select("anchor", "core"), "shared"), ["anchor", "core"]).select(
            "h", "place", F.lit(-1).alias("part"), "anchor", "first", "last", "done", "data")
        cells = _rows
        if size == 1 or rows.limit(1).count() == 0:
            break
    return reduce(DataFrame.union, found)


def _wanted(kinds):
    """The cells of each text: (h, place, wanted)."""
    return kinds.withColumn("done", F.col("n") > 1).groupBy("h", "place").agg(
        F.collect_list(F.struct("part", "anchor", "first", "last", "done")).alias("wanted"))


def repeated_runs(docs, texts, hot=HOT, part=PART):
    """(h, place, a, b): runs of window starts that occur elsewhere. ``docs`` has every
    row's text with its hashes h and place, ``texts`` each different text once."""
    rows = stored(_cell_rows(docs), "all-cells")
    # Written, so that the join below deals out both of its sides and can split a hot anchor.
    often = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "often")
    rows = stored(rows.join(often, "anchor"), "cells")
    one = [F.first(c).alias(c) for c in ("h", "place", "first", "last")]
    kinds = stored(rows.groupBy("anchor", "cell").agg(F.count(F.lit(1)).alias("n"), *one), "kinds")
    decided = rows.join(kinds.filter("n > 1").select("anchor", "cell"), ["anchor", "cell"]).select(
        "h", "place", F.col("first").alias("a"), F.col("last").alias("b"))

    size = F.col("last") - F.col("first") + LENGTH
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"), F.sum((F.col("n") == 1).cast("int")).alias("open"))
    anchors = stored(anchors.filter("m > 1 and open > 0").withColumn("hot", (F.col("m") > hot) | (F.col("bytes") > part)).drop("open"), "anchors")
    dealt = running_totals(anchors.filter("not hot"), [], ["anchor"], "bytes", "before")
    dealt = dealt.select("anchor", F.floor(F.col("before") / part).cast("int").alias("part"))
    cut = _cut(texts.join(_wanted(kinds.join(dealt, "anchor")), ["h", "place"]).select("h", "place", "text", "wanted"))
    runs = decided.union(cut.groupBy("part").applyInPandas(_sort_part, "h long, place long, a int, b int"))
    # Written, so that where they are few they are sent to the texts, and not the texts to them.
    heated = stored(anchors.filter("hot").select("anchor", F.lit(-1).alias("part")), "hot")
    if not heated.limit(1).count():
        return runs
    wanted = stored(_wanted(kinds.join(heated, "anchor")), "hot-cells")
    few = docs.join(wanted.select("h", "place"), ["h", "place"], "left_semi").dropDuplicates(["h", "place"])
    return runs.union(_hot_runs(few.join(wanted, ["h", "place"]).select("h", "place", "text", "wanted")))


def _removed(data, runs):
    """(bytes removed, runs of them, digest of the rest)."""
    if not runs:
        return 0, 0, hashlib.sha256(data).hexdigest()
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, [r["a"] for r in runs], 1)
    np.add.at(edges, [r["b"] + LENGTH for r in runs], -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def without_repeats(docs, hot=HOT, part=PART):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty; texts under ``LENGTH`` bytes keep everything; repeated rows
    are copies of each other and lose all that is long enough; null ids stay; an empty
    table gives none."""
    text = F.coalesce("text", F.lit(""))
    plain = pick(docs, "doc_id", "text").withColumn("text", text).withColumns({"h": F.xxhash64("text"), "place": F.xxhash64("text", F.lit(1))})
    keyed = plain.select("h", "place", "text")
    texts = keyed.dropDuplicates(["h", "place"])
    runs = repeated_runs(keyed, texts, hot, part).groupBy("h", "place").agg(F.collect_set(F.struct("a", "b")).alias("runs"))

    def run(batches):
        for batch in batches:
            rows = []
            for h, g, t, found in _rows(batch):
                data = t.encode("utf-8", "replace")
                rows.append((h, g, len(data), *_removed(data, found)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 5 else pa.int64()) for i, c in enumerate(columns)],
                                             names=["h", "place", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = texts.join(runs, ["h", "place"], "left").select("h", "place", "text", "runs").mapInArrow(
        run, "h long, place long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.select("doc_id", "h", "place").join(stored(done, "digests"), ["h", "place"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
