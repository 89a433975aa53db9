"""Best-two-fit packing of documents into training sequences.

Documents are cut into pieces of at most one sequence. Only the number of pieces of
each length decides how they are packed, and there are no more lengths than tokens in
a sequence, so the packing works on that histogram: a bin is filled greedily, its
smallest piece is swapped for two unpacked ones that fill the widened gap more tightly,
and the bin's pattern is repeated while its lengths last. The plan is a list of runs
"pieces r to s of length l go to these sequences, at this offset"; every piece then
finds its place by its number among the pieces of its length, which a distributed
running count gives.
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from flowgauge.functions.running import running_totals
from flowgauge.llm.shared import add_columns, pick
from flowgauge.session import stored

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
CACHED = 200_000        # words of a generation whose ids a worker remembers
TOGETHER = 20_000       # words that are tokenized in one go
CHUNK = 1 << 20         # characters that are tokenized at a time
MARK = re.compile(rb"(?<=[a-z])[.,](?=[ \n]|\Z)")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def tokenizer_file(name):
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. White space never joins tokens of
    this tokenizer, so every word is tokenized once and remembered, in two generations:
    a word of the older one that occurs again moves to the younger.

    The tokenizer lowers case itself and parts letters from marks, so words are looked
    up in lower case (A-Z) and without a point or comma behind a letter, unless a text
    may hold special tokens, whose strings it takes as they are."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _tokenized(self, words):
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _tokenized_plain(self, words):
        """Words of letters alone: in one go, cut behind every token that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(words) + 1:
            return self._tokenized(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def __call__(self, texts):
        split = []
        for text in texts:
            data = text.encode("utf-8", "replace")
            split.append((data if b"<|" in data else MARK.sub(rb" \g<0>", data.lower())).split())
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        new = set().union(*split).difference(self.young)
        again = [word for word in new if word in self.old]
        self.young.update((word, self.old[word]) for word in again)
        decoded = {word: word.decode() for word in new.difference(again)}
        for plain, how in ((True, self._tokenized_plain), (False, self._tokenized)):
            some = [word for word, text in decoded.items() if bool(PLAIN.fullmatch(text)) == plain]
            for at in range(0, len(some), TOGETHER):
                part = some[at:at + TOGETHER]
                self.young.update(zip(part, how([decoded[word] for word in part])))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]


_ENCODERS = {}


def encoder(path):
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _chunks(texts):
    """(row, text) of an Arrow array, in lists of about ``CHUNK`` characters."""
    chunk, size = [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        chunk.append((i, text))
        size += len(text)
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def pieces(docs, tokenizer=TOKENIZER, capacity=CAPACITY, with_ids=False):
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, ids.

    A null or empty text is the end token alone. Longer documents are cut every
    ``capacity`` tokens; repeated rows give repeated pieces; null ids stay null."""
    plain = pick(docs, "doc_id", "text")
    fields = [StructField("doc_id", plain.schema["doc_id"].dataType), StructField("piece", IntegerType()),
              StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    fields += [StructField("ids", ArrayType(IntegerType(), False))] if with_ids else []

    def run(batches):
        encode = encoder(tokenizer_file(tokenizer))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for chunk in _chunks(batch.column(1)):
                out, tokens = [], []
                for (row, _), data in zip(chunk, encode([t for _, t in chunk])):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        out.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            tokens.append(np.frombuffer(part, "<i4"))
                row, k, start, length, crc = map(list, zip(*out))
                columns = [ids.take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return plain.mapInArrow(run, StructType(fields))


def best_two_fit(counts, capacity=CAPACITY):
    """Patterns (repeats, {length: pieces}) that pack ``counts[length]`` pieces."""
    left = np.array(counts, np.int64)
    sizes = np.arange(capacity + 1)
    patterns = []
    while (have := left > 0).any():
        largest = np.maximum.accumulate(np.where(have, sizes, 0))     # the largest length in stock up to x
        taken, gap, x = {}, capacity, capacity
        while (size := int(largest[x])) > 0:
            many = min(int(left[size]), gap // size)
            taken[size] = many
            gap -= many * size
            x = min(gap, size - 1)
        if gap:
            _swap_smallest(left, taken, gap, sizes)
        repeats = min(int(left[s]) // n for s, n in taken.items())
        for size, n in taken.items():
            left[size] -= repeats * n
        patterns.append((repeats, taken))
    return patterns


def _swap_smallest(left, taken, gap, sizes):
    """Replace the smallest piece of a bin by the two unpacked ones, if any, that fill
    more of its place and the gap."""
    smallest = min(taken)
    room = gap + smallest
    stock = left.copy()
    for size, n in taken.items():
        stock[size] -= n
    largest = np.maximum.accumulate(np.where(stock > 0, sizes, 0))
    first = sizes[1:room][stock[1:room] > 0]
    if not len(first):
        return
    twice = np.where((stock[first] > 1) & (2 * first <= room), first, 0)
    second = np.maximum(twice, largest[np.minimum(room - first, first - 1)])
    filled = np.where(second > 0, first + second, 0)
    best = int(filled.argmax())
    if filled[best] <= smallest:
        return
    taken[smallest] -= 1
    if not taken[smallest]:
        del taken[smallest]
    for size in (int(first[best]), int(second[best])):
        taken[size] = taken.get(size, 0) + 1


def runs(patterns, capacity=CAPACITY):
    """Arrays, sorted by (length, from): the run of pieces of one length that starts at
    number ``from`` goes ``each`` to a sequence, from ``sequence`` on, at ``offset``."""
    at, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for repeats, taken in patterns:
        offset = 0
        for size in sorted(taken, reverse=True):
            rows.append((size, int(at[size]), sequence, taken[size], offset))
            at[size] += repeats * taken[size]
            offset += size * taken[size]
        sequence += repeats
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: rows[:, i] for i, name in enumerate(("length", "from", "sequence", "each", "offset"))}


def pack(cut, capacity=CAPACITY):
    """Adds sequence_id and offset to the rows of ``pieces``.

    The histogram brought to the driver has at most ``capacity`` rows. A pattern uses
    up a length or leaves fewer pieces of it than it takes, so there are at most some
    three patterns a length, each of at most 90 different lengths: the runs sent to
    the tasks have a bound that does not depend on the documents."""
    cut = stored(cut, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = runs(best_two_fit(counts, capacity), capacity)
    most = int(counts.max()) + 1
    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "ids_crc32"]
    numbered = running_totals(cut.withColumns({"_one": F.lit(1), "_draw": order[0]}), ["length"], ["_draw", *order[1:]], "_one", "_rank")
    numbered = numbered.drop("_one", "_draw")
    length_at, rank_at = numbered.columns.index("length"), numbered.columns.index("_rank")

    def place(batch):
        length = batch.column(length_at).to_numpy(zero_copy_only=False)
        rank = batch.column(rank_at).to_numpy(zero_copy_only=False)
        run = np.searchsorted(plan["length"] * most + plan["from"], length * most + rank, "right") - 1
        within = rank - plan["from"][run]
        each = plan["each"][run]
        return [pa.array(plan["sequence"][run] + within // each), pa.array(plan["offset"][run] + within % each * length)]

    return add_columns(numbered, place, "sequence_id long, offset long").select(*cut.columns, "sequence_id", "offset")


def sequences(packed):
    """The token ids of each sequence, from pieces packed ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
