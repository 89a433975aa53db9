"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the tokens on both sides of it, as if it alone were
masked; the summed log-probabilities score a document. The network adds up one embedding
per place in the window, squashes the sum, and predicts an id in two steps (its group,
then its member of the group given that), so that a prediction costs two small softmaxes.

Tokens are the words themselves. All words are counted in Spark; those that occur often
enough are listed. The most frequent have an id of their own, the other listed ones share
ids and are told apart by their counts, and a word off the list has an id by its first
bytes and is told apart by its spelling: a byte model of all such words, given that id.

It is trained in numpy where the data lies: each task runs over all its tokens from the
same start, and the networks are averaged, weighted by the tokens each has seen. A
first, lighter round over a part of the texts moves the start off its random place, so
that the networks of the last round, which reads every token, stay close enough to be
averaged. What reaches the driver is one network, whatever the corpus.
"""

import uuid
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowgauge.llm.shared import add_columns, pick
from flowgauge.session import stored

SIDE = 32               # groups, and members of a group
WIDE_SIDE = 64          # of a corpus that lists more words than fit into the smaller
VOCABULARY = SIDE * SIDE
PAD = VOCABULARY        # the place after the last id, at any side
WIDTH = 32
PLACES = (-2, -1, 1, 2)
BATCH = 4096            # tokens of a training step
BUFFER = 1 << 17        # tokens that are shuffled and trained on, or scored, together
RATE = 0.08
FIRST = 8               # the first round reads one text in this many
BLOCK = 2048            # numbers of a row in which networks travel
CACHED = 300_000        # words off the list that are remembered
LEAST = 5               # occurrences of a listed word
MOST = 500_000          # listed words, for the memory of a Python worker
COUNTED = 200_000       # words that a task counts before it passes them on
END = 32                # the byte around words
TIMES = 8               # rows of one index that are added up together with those of others
SAFE = 60.0             # logits whose exponentials fit into 32-bit floats


def shapes(side):
    return {"embed": (len(PLACES), side * side + 1, WIDTH), "shift": (WIDTH,), "group": (WIDTH, side), "group_shift": (side,),
            "member": (WIDTH, side), "member_shift": (side, side)}


SHAPES = shapes(SIDE)


def start(seed=5, side=SIDE):
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * (0.1 if k in ("embed", "group", "member") else 0.0)).astype(np.float32) for k, s in shapes(side).items()}


def flat(net):
    return np.concatenate([net[k].ravel() for k in SHAPES])


def shaped(numbers, side=SIDE):
    found = shapes(side)
    ends = np.cumsum([int(np.prod(s)) for s in found.values()])
    return {k: part.reshape(s).copy() for (k, s), part in zip(found.items(), np.split(np.asarray(numbers, np.float32), ends[:-1]))}


def _kind(byte):
    """Bytes made alike for the place before the last: letters, digits, others, beyond ASCII."""
    if byte == END:
        return 0
    if 97 <= byte <= 122:
        return byte - 96
    return 27 if 48 <= byte <= 57 else 28 if byte < 128 else 29 + (byte >> 5 & 1)


KIND = [_kind(b) for b in range(256)]
KIND_OF = np.array(KIND)
KINDS = 32


def _opening(a, b, c, rest):
    """Number, of ``rest``, of a word that starts with these bytes (END beyond its end)."""
    return (a * 7919 + b * 263 + c * 31) % rest


class Listing:
    """The ids of a corpus's words, and their log-probabilities given the id.

    ``words`` and ``counts`` are the listed words, the most frequent first. ``spelling``
    has the occurrences of (kind of the byte before last, last byte, byte) in the rest."""

    def __init__(self, words=(), counts=(), spelling=None):
        self.side = SIDE if len(words) <= VOCABULARY - VOCABULARY // 8 else WIDE_SIDE
        size = self.side * self.side
        self.rest = size // 8 if len(words) else size
        shared = size // 4 if len(words) > size - self.rest else 0
        self.own, self.shared = min(len(words), size - self.rest - shared), shared
        self.words, ranks = b" ".join(words), np.arange(len(words))
        self.ids = np.where(ranks < self.own, ranks, 0).astype(np.int64)
        if shared:
            self.ids[self.own:] = [self.own + zlib.crc32(w) % shared for w in words[self.own:]]
        counts = np.asarray(counts, np.float64)
        total = np.bincount(self.ids, counts, size) if len(words) else np.zeros(size)
        self.given = np.log(counts / total[self.ids]).astype(np.float32)
        self.spelled = None if spelling is None else self._spelled(spelling)

    def rest_id(self, word):
        first = (*word[:3], END, END)
        return self.own + self.shared + _opening(first[0], first[1], first[2], self.rest)

    def of_rest(self, words):
        """Ids, and log-probabilities given them, of words off the list."""
        text = np.frombuffer(b" " + b" ".join(words) + b"    ", np.uint8).astype(np.int64)
        stops = np.flatnonzero(text[:-3] == END)
        starts, stops = stops[:-1] + 1, stops[1:]
        a, b, c = (np.where(starts + k < stops, text[np.minimum(starts + k, stops)], END) for k in range(3))
        opening = _opening(a, b, c, self.rest)
        table, share = self.spelled
        # A word's bytes and its end, each after two; the end of a word stands before the next.
        last = np.concatenate([[END], text[:-1]])
        one_before = np.concatenate([[END], last[:-1]])
        one_before[starts] = END
        steps = table[(KIND_OF[one_before] * 256 + last) * 256 + text]
        numbers = np.repeat(np.arange(len(words)), stops - starts + 1)
        total = np.bincount(numbers, steps[starts[0]:stops[-1] + 1], len(words))
        return self.own + self.shared + opening, np.minimum(0.0, total - share[opening])

    def _spelled(self, counts):
        """Log-probabilities of a byte after two, and of each opening's share."""
        counts = counts.reshape(KINDS, 256, 256).astype(np.float64)
        one = counts.sum((0, 1)) + 0.01
        two = counts.sum(0)
        two = (two + 20 * one / one.sum()) / (two.sum(1, keepdims=True) + 20)
        table = (counts + 5 * two) / (counts.sum(2, keepdims=True) + 5)
        share, b = np.zeros(self.rest), np.arange(256)
        kind = np.array(KIND)
        for a in b[b != END]:
            p = table[0, END, a] * table[0, a]                                  # of each second byte
            third = p[:, None] * table[kind[a], b]
            third[END] = 0
            third[END, END] = p[END]                                            # the word has one byte
            share += np.bincount(_opening(a, b[:, None], b, self.rest).ravel(), third.ravel(), self.rest)
        return np.log(table).astype(np.float32).ravel(), np.log(share)


class Words(dict):
    """Id of a word: the listed ones, and others as they are met."""

    def __init__(self, listing=None):
        self.listing = listing or Listing()
        super().__init__(zip(self.listing.words.split(b" "), self.listing.ids.tolist()) if self.listing.words else ())
        self.room = len(self) + CACHED

    def made(self, word):
        return self.listing.rest_id(word)

    def __missing__(self, word):
        got = self.made(word)
        if len(self) < self.room:
            self[word] = got
        return got


class Ranks(dict):
    """Rank of a listed word; of others what ``get`` is told."""

    def __init__(self, listing):
        super().__init__(zip(listing.words.split(b" "), range(len(listing.ids))) if listing.words else ())


class Given(Words):
    """Log-probability of a word given its id."""

    def __init__(self, listing):
        super().__init__(listing)
        self.update(zip(list(self), listing.given.tolist()))
        table, self.share = listing.spelled
        self.table = memoryview(table)

    def made(self, word):
        total, kind, last = 0.0, 0, END
        for byte in (*word, END):
            total += self.table[(kind * 256 + last) * 256 + byte]
            kind, last = KIND[last], byte
        rest = self.listing.rest_id(word) - self.listing.own - self.listing.shared
        return min(0.0, total - self.share[rest])


def word_counts(texts):
    """word (bytes), n: how often each word occurs; tasks add up first."""
    def count(batches):
        def rows(tally):
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

        tally = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(text.encode("utf-8", "replace").lower().split())
                if len(tally) > COUNTED:
                    yield rows(tally)
                    tally = Counter()
        if tally:
            yield rows(tally)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def listing(texts):
    """The listing of a corpus. Its words are as many as occur ``LEAST`` times; beyond
    ``MOST`` the rarer ones, all of a count together, are told by their spelling."""
    counts = stored(word_counts(texts), "words")
    least, size = LEAST, 0
    for n, words in sorted(counts.filter(F.col("n") >= LEAST).groupBy("n").count().collect(), reverse=True):
        size += words
        if size > MOST:
            least = n + 1
            break

    def bytes_of(batches):
        sums = np.zeros(KINDS * 256 * 256, np.int64)
        kinds = np.array(KIND)
        for batch in batches:
            words = batch.column(0).to_pylist()
            text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
            ends = np.flatnonzero(text == END)[1:]
            times = np.repeat(batch.column(1).to_numpy(), np.diff(ends, prepend=0))     # a word's bytes and its end
            before = np.concatenate([[END], text[:-2]])
            before[np.flatnonzero(text[:-1] == END)] = END
            sums += np.bincount((kinds[before] * 256 + text[:-1]) * 256 + text[1:], times, len(sums)).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["at", "n"])

    spelling = np.zeros(KINDS * 256 * 256, np.int64)
    found = counts.filter(F.col("n") < least).mapInArrow(bytes_of, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    spelling[found["at"].to_numpy()] = found["n"].to_numpy()
    listed = counts.filter(F.col("n") >= least).toArrow()
    pairs = sorted(zip(listed["n"].to_pylist(), listed["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return Listing([w for _, w in pairs], [n for n, _ in pairs], spelling)


_MADE = {}


def _known(kind, listed):
    """The dictionary of a broadcast listing: made once in a Python worker, and the last
    of its kind only, since workers outlive their tasks."""
    if _MADE.get(kind, (None, None))[0] != listed.value[0]:
        _MADE[kind] = (listed.value[0], kind(listed.value[1]))
    return _MADE[kind][1]


def encoded(text, words):
    return np.fromiter(map(words.__getitem__, text.encode("utf-8", "replace").lower().split()), np.int64)


def _exponentials(x, weights, shift):
    """exp(x), in the place of x, the sums of its rows, and their sums' logarithms before
    rows were moved. No hidden number is beyond 1, so the weights bound the logits: where
    these cannot overflow they stay, else every row is moved to its maximum first."""
    top = 0.0
    if np.abs(weights).sum(0).max() + np.abs(shift).max() >= SAFE:
        top = x.max(1)
        x -= top[:, None]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    return x, sums, np.log(sums) + top


def _logits(net, around, target):
    h = np.take(net["embed"][0], around[0], 0)
    for k in range(1, len(PLACES)):
        h += np.take(net["embed"][k], around[k], 0)
    h += net["shift"]
    np.tanh(h, out=h)
    group = target // len(net["group_shift"])
    first = h @ net["group"]
    first += net["group_shift"]
    second = h @ net["member"]
    second += np.take(net["member_shift"], group, 0)
    return h, group, first, second


def _forward(net, around, target):
    """The hidden numbers, the targets' groups, and the log-probabilities of all groups
    and of all members of the target's group."""
    h, group, first, second = _logits(net, around, target)
    logs = [x - _exponentials(x.copy(), net[k], net[k + "_shift"])[2][:, None] for k, x in (("group", first), ("member", second))]
    return h, group, *logs


def _laid_out(documents, pad):
    """Tokens in one array with padding between documents, and where tokens are."""
    gap = np.full(max(PLACES), pad, np.int64)
    ids = np.concatenate([gap, *[part for d in documents for part in (d, gap)]])
    return ids, np.flatnonzero(ids != pad)


def log_probabilities(net, documents):
    """Log-probability of every token of the documents, one after another."""
    side = len(net["group_shift"])
    ids, at = _laid_out(documents, side * side)
    out = np.empty(len(at))
    for low in range(0, len(at), BATCH):
        here = at[low:low + BATCH]
        target = ids[here]
        _, group, first, second = _logits(net, [ids[here + p] for p in PLACES], target)
        rows = np.arange(len(here))
        picked = first[rows, group] + second[rows, target % side]
        for k, x in (("group", first), ("member", second)):
            picked -= _exponentials(x, net[k], net[k + "_shift"])[2]
        out[low:low + BATCH] = picked
    return out


def _summed_by(index, rows):
    """The different indices, and the sums of their rows: index i is that of row i modulo
    their number. Most indices occur a few times, so that all second rows, all third rows
    and so on are added up together, in the order of ``np.add.reduceat`` (the first row
    to the sum of the rest), which sums what occurs more than ``TIMES`` times."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(starts, append=len(index))
    kinds = TIMES + 1 - np.minimum(sizes, TIMES + 1)
    by_size = np.argsort(kinds.astype(np.uint8), kind="stable")             # the most frequent first
    many = np.cumsum(np.bincount(kinds, minlength=TIMES + 1))[::-1]         # indices that occur more than k times
    starts, sizes = starts[by_size], sizes[by_size]
    order = np.tile(np.arange(len(rows)), len(index) // len(rows))[order]
    sums, often = np.take(rows, order[starts], 0), many[TIMES]
    if many[1]:
        rest = np.take(rows, order[starts[:many[1]] + 1], 0)
        for k in range(2, TIMES):
            if many[k] > often:
                rest[often:many[k]] += np.take(rows, order[starts[often:many[k]] + k], 0)
        sums[often:many[1]] += rest[often:]
    if often:
        ends = np.cumsum(sizes[:often])
        at = np.arange(ends[-1]) + np.repeat(starts[:often] - ends + sizes[:often], sizes[:often])
        sums[:often] = np.add.reduceat(np.take(rows, order[at], 0), ends - sizes[:often], axis=0)
    return ordered[starts], sums


def _rows_of(table):
    """The rows of a table as single values, which numpy puts in place faster than their numbers."""
    return table.view(np.dtype((np.void, table.strides[0]))).ravel()


def _moved(numbers, memory, slope, at=None):
    """Moves all numbers, or the rows ``at``, by a slope that is used up."""
    past = memory if at is None else np.take(memory, at, 0)
    past += slope * slope
    slope *= RATE
    if at is None:
        slope /= np.sqrt(past)
        numbers -= slope
        return
    _rows_of(memory)[at] = _rows_of(past)
    slope /= np.sqrt(past, out=past)
    np.subtract(np.take(numbers, at, 0), slope, out=slope)
    _rows_of(numbers)[at] = _rows_of(slope)


def step(net, memory, around, target):
    """One step of gradient descent with a rate per number (by past squares)."""
    h, group, first, second = _logits(net, around, target)
    n, rows = len(target), np.arange(len(target))
    d_first, sums, _ = _exponentials(first, net["group"], net["group_shift"])
    d_first *= (1 / (n * sums))[:, None]
    d_second, sums, _ = _exponentials(second, net["member"], net["member_shift"])
    d_second *= (1 / (n * sums))[:, None]
    d_first[rows, group] -= 1 / n
    d_second[rows, target % len(net["group_shift"])] -= 1 / n
    d_h = d_first @ net["group"].T
    d_h += d_second @ net["member"].T
    d_h *= 1 - h * h
    slopes = {"shift": d_h.sum(0), "group": h.T @ d_first, "group_shift": d_first.sum(0), "member": h.T @ d_second}
    for k, slope in slopes.items():
        _moved(net[k], memory[k], slope)
    # Only rows that were met have a slope.
    at, slope = _summed_by(group.astype(np.uint16), d_second)
    _moved(net["member_shift"], memory["member_shift"], slope, at)
    flat_embed, flat_memory = (x["embed"].reshape(-1, WIDTH) for x in (net, memory))
    places = np.concatenate([a + k * net["embed"].shape[1] for k, a in enumerate(around)])
    at, slope = _summed_by(places.astype(np.uint16), d_h)       # 4 times 4,097 numbers at most
    _moved(flat_embed, flat_memory, slope, at)


def trained(net, documents):
    """The network after all tokens of an iterator of documents' ids, and their number."""
    net = {k: v.copy() for k, v in net.items()}
    memory = {k: np.full(v.shape, 1e-8, np.float32) for k, v in net.items()}
    rng, held, size, seen = np.random.default_rng(11), [], 0, 0
    pad = net["embed"].shape[1] - 1

    def consume():
        ids, at = _laid_out(held, pad)
        rng.shuffle(at)
        for low in range(0, len(at), BATCH):
            here = at[low:low + BATCH]
            step(net, memory, [ids[here + p] for p in PLACES], ids[here])
        return len(at)

    for document in documents:
        held.append(document)
        size += len(document)
        if size >= BUFFER:
            seen += consume()
            held, size = [], 0
    return net, seen + (consume() if size else 0)


def _round(coded, net):
    """The average of the networks that the tasks train from ``net`` on the ids of texts."""
    def train(batches):
        after, seen = trained(net, (_unpacked(x) for b in batches for x in b.column(0)))
        if seen:
            numbers = flat(after).astype(np.float64) * seen
            parts = [numbers[i:i + BLOCK] for i in range(0, len(numbers), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()),
                 pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))], names=["block", "seen", "numbers"])

    def add(batches):
        sums = {}
        for batch in batches:
            for block, seen, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                numbers = numbers.values.to_numpy()
                before = sums.get(block, (0, 0.0))
                sums[block] = before[0] + seen, before[1] + numbers
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s for s, _ in sums.values()], pa.int64()),
             pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))], names=["block", "seen", "numbers"])

    schema = "block int, seen long, numbers array<double>"
    rows = coded.mapInArrow(train, schema).repartition("block").mapInArrow(add, schema).orderBy("block").collect()
    return shaped(np.concatenate([np.array(r["numbers"]) / r["seen"] for r in rows]), len(net["group_shift"])) if rows else net


def _texts(docs):
    return docs.select("text").filter(F.col("text").isNotNull())


def _shared(spark, listed):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, listed))


def _unpacked(ids):
    return np.frombuffer(ids.as_buffer(), "<u2").astype(np.int64)


def with_ids(docs, listed, text="text"):
    """``docs`` without their texts, with the ids of their tokens (``ids``, two bytes each)
    and ``apart``, the summed log-probabilities of the words given their ids. Written, so
    that texts are split and looked up once for all that is done with them."""
    at = docs.columns.index(text)

    def looked_up(texts):
        ranks, listing = _known(Ranks, listed), listed.value[1]
        tokens = [t for text in texts for t in text]
        at = np.fromiter(map(ranks.get, tokens, repeat(-1)), np.int64, len(tokens))
        off = np.flatnonzero(at < 0)
        ids, given = np.zeros(len(at), "<u2"), np.zeros(len(at))
        if len(off) < len(at):
            ids, given = listing.ids[at].astype("<u2"), listing.given[at].astype(np.float64)
        if len(off):
            ids[off], given[off] = listing.of_rest([tokens[i] for i in off.tolist()])
        sizes = [len(text) for text in texts]
        ends = np.cumsum(sizes).tolist()
        return ([ids[e - n:e].tobytes() for e, n in zip(ends, sizes)],
                np.bincount(np.repeat(np.arange(len(texts)), sizes), given, len(texts)).tolist())

    def make(batch):
        ids, apart, held, size = [], [], [], 0
        for value in batch.column(at):
            held.append((value.as_py() or "").encode("utf-8", "replace").lower().split())
            size += len(held[-1])
            if size >= BUFFER:
                ids, apart, held, size = *(x + y for x, y in zip((ids, apart), looked_up(held))), [], 0
        if held:
            ids, apart = (x + y for x, y in zip((ids, apart), looked_up(held)))
        return [pa.array(ids, pa.binary()), pa.array(apart, pa.float64())]

    return stored(add_columns(docs, make, "ids binary, apart double").drop(text), "ids")


def fit(docs, listed=None):
    """A network trained on every token of ``docs`` (null texts have none), over the ids
    of a broadcast listing; without one every word has an id by its first bytes."""
    listed = listed or _shared(docs.sparkSession, Listing(spelling=np.zeros(KINDS * 256 * 256, np.int64)))
    return fit_ids(with_ids(_texts(docs), listed), listed.value[1].side)


def fit_ids(coded, side):
    """A network trained on every token of the ids of ``with_ids``."""
    coded = coded.select("ids").filter(F.length("ids") > 0)
    net = _round(coded.filter(F.pmod(F.xxhash64("ids"), F.lit(FIRST)) == 0), start(side=side))
    return _round(coded, net)


def _grouped(column):
    """The documents' ids, a buffer at a time."""
    held, size = [], 0
    for ids in column:
        held.append(_unpacked(ids))
        size += len(held[-1])
        if size >= BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def scored(docs):
    """doc_id, n_tokens, log_probability (summed over tokens) and mean_log_probability
    of every document under a network trained on all of them.

    A null text, or one without a word, has the sum 0 and no mean; copies of a text
    have equal scores; an empty table gives none."""
    plain = pick(docs, "doc_id", "text")
    listed = _shared(plain.sparkSession, listing(_texts(plain)))
    coded = with_ids(plain, listed)
    net = fit_ids(coded, listed.value[1].side)

    def make(batch):
        lengths, sums = [], []
        for documents in _grouped(batch.column(1)):
            ends = np.cumsum([0, *map(len, documents)])
            total = np.concatenate([[0.0], np.cumsum(log_probabilities(net, documents))])
            lengths += np.diff(ends).tolist()
            sums += (total[ends[1:]] - total[ends[:-1]]).tolist()
        sums = [s + a for s, a in zip(sums, batch.column(2).to_pylist())]
        return [pa.array(lengths, pa.int64()), pa.array(sums, pa.float64()),
                pa.array([s / n if n else None for s, n in zip(sums, lengths)], pa.float64())]

    return add_columns(coded, make, "n_tokens long, log_probability double, mean_log_probability double").drop("ids", "apart")
