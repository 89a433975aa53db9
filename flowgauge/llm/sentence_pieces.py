"""SentencePiece encoding that keeps the place of every piece in the original text.

Texts are normalised here, by the longest prefix found in the model's compiled character
map, with the original byte of every normalised byte at hand. The pieces of the
normalised text come from the model itself, its own normaliser switched off; as a piece
covers a known number of normalised bytes, its span in the original follows.

Nothing is merged across the start of a run of space symbols unless a piece holds the
symbol behind another character. Where no piece does (it is looked up), words are encoded
once and remembered, and long texts are worked through in windows.
"""

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from flowgauge.llm.shared import pick

MODEL = "piece_bpe_32k.model"
SPACE = "▁"                    # stands for a space in pieces
SPACE_BYTES = SPACE.encode()
UNKNOWN_BYTE = "�".encode()    # what a byte that is not UTF-8 becomes
WINDOW = 1 << 18        # bytes of text that are worked on at a time
REMEMBERED = 100_000    # words of a generation whose ids a worker remembers
LONG_WORD = 64          # longer words are not remembered
CUT = re.compile(rb"(?<=[0-9A-Za-z])(?= )")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6     # kinds of pieces, as the format numbers them


def model_file(name):
    import public_tokenizers
    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled map of a model: a double array trie over byte strings, and the
    zero-terminated strings that they become."""

    def __init__(self, compiled):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").astype(np.int64)
        self.strings = compiled[4 + size:]

    def _step(self, node):
        unit = self.units[node]
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data, starts):
        """For each start: the bytes of the longest entry that begins there (0: none) and
        the place of its string. All starts go down the trie together."""
        length, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, place
        live = np.arange(len(starts))
        node = np.full(len(starts), self._step(0))
        depth = 0
        while len(live):
            inside = starts[live] + depth < len(data)
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            found = node < len(self.units)
            live, node, byte = live[found], node[found], byte[found]
            found = (self.units[node] & 0x800000FF) == byte
            live, node = live[found], node[found]
            depth += 1
            leaf = (self.units[node] >> 8) & 1 == 1
            node = node ^ self._step(node)
            length[live[leaf]] = depth
            place[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, place

    def string(self, place):
        return self.strings[place:self.strings.index(b"\0", place)]

    def reaches(self, byte):
        """Whether an entry holds the byte behind its first one."""
        level, first = [self._step(0)] if len(self.units) else [], True
        every = np.arange(1, 256)
        while level:
            nodes = (np.array(level)[:, None] ^ every[None, :])
            known = np.where(nodes < len(self.units), self.units[np.minimum(nodes, len(self.units) - 1)], -1)
            row, column = np.nonzero((known & 0x800000FF) == every[None, :])
            if not first and byte in every[column]:
                return True
            ahead = nodes[row, column]
            level, first = (ahead ^ self._step(ahead)).tolist(), False
        return False


class Normalizer:
    """A model's normalisation, with the original byte of every byte that it makes."""

    def __init__(self, spec, kept=(), suffix=False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = suffix
        self.kept = re.compile(b"|".join(re.escape(k) for k in sorted(kept, key=len, reverse=True))) if kept else None
        self._windows = None

    def windows_allowed(self):
        """Whether a text can be cut before a space that follows a letter or digit."""
        if self._windows is None:
            plain = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
            length, place = self.map.longest(plain, np.arange(len(plain)))
            ends = [self.map.string(p) for p in place[length == 1]]
            self._windows = (self.kept is None and not self.map.reaches(32)
                             and not any(not e or e.endswith((b" ", SPACE_BYTES)) for e in ends))
        return self._windows

    def _edits(self, text, data, starts, broken):
        """(start, end, replacement) from left to right: map entries and broken bytes."""
        edits = [(at, at + 1, UNKNOWN_BYTE) for at in broken]
        length, place = self.map.longest(data, starts)
        found = np.flatnonzero(length)
        edits += [(int(starts[i]), int(starts[i] + length[i]), self.map.string(int(place[i]))) for i in found]
        if self.kept is not None:       # symbols of the user's go before the map and stay
            edits += [(m.start(), m.end(), None) for m in self.kept.finditer(text)]
        edits.sort(key=lambda e: (e[0], e[2] is not None))
        at = 0
        for edit in edits:
            if edit[0] >= at:
                at = edit[1]
                yield edit

    def __call__(self, text, first=True, last=True):
        """The normalised bytes and, with one entry more, where in ``text`` each came from.

        Bytes that are not UTF-8 become U+FFFD one by one. ``first`` and ``last`` tell a
        window that begins or ends its text."""
        data = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        broken = ()
        try:
            text.decode()
        except UnicodeDecodeError:
            lone = text.decode("utf-8", "surrogateescape")
            sizes = np.array([len(c.encode("utf-8", "surrogateescape")) for c in lone], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            broken = [int(a) for a, c in zip(starts, lone) if "\udc80" <= c <= "\udcff"]
        origin = np.repeat(starts, np.diff(np.append(starts, len(data))))
        parts, origins, at = [], [], 0
        for start, end, made in self._edits(text, data, starts, broken):
            if made is None:
                continue
            parts += [data[at:start], np.frombuffer(made, np.uint8)]
            origins += [origin[at:start], np.full(len(made), start)]
            at = end
        if at:
            data, origin = np.concatenate([*parts, data[at:]]), np.concatenate([*origins, origin[at:]])
        end = len(text)
        if self.squeeze:        # without spaces that follow a space or begin the text
            space = data == 32
            keep = ~(space & np.concatenate([[first], space[:-1]]))
            data, origin = data[keep], origin[keep]
        if not len(data):
            return data, np.zeros(1, np.int64)
        if self.escape:
            data, origin = self._escaped(data, origin)
        mark = np.frombuffer(SPACE_BYTES if self.escape else b" ", np.uint8)
        if self.dummy and first and not self.suffix:
            data, origin = np.concatenate([mark, data]), np.concatenate([np.full(len(mark), origin[0]), origin])
        if self.squeeze and last:       # nor what ends it, be it a space or the symbol itself
            while len(data) >= len(mark) and (data[-len(mark):] == mark).all():
                data, origin, end = data[:-len(mark)], origin[:-len(mark)], int(origin[-len(mark)])
        if self.dummy and last and self.suffix:
            data, origin = np.concatenate([data, mark]), np.concatenate([origin, np.full(len(mark), end)])
        return data, np.append(origin, end)

    @staticmethod
    def _escaped(data, origin):
        space = data == 32
        times = np.where(space, len(SPACE_BYTES), 1)
        out = np.repeat(data, times)
        at = (np.cumsum(times) - times)[space]
        for k, byte in enumerate(SPACE_BYTES):
            out[at + k] = byte
        return out, np.repeat(origin, times)


class Model:
    """A model with byte pieces: ids and spans of texts, window by window."""

    def __init__(self, path=None, proto=None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        spec = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        spec.ParseFromString(proto)
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("spans are worked out from ids, which takes a model with byte pieces")
        kept = [p.piece.encode() for p in spec.pieces if p.type == USER_DEFINED]
        suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.normalizer = Normalizer(spec.normalizer_spec, kept, suffix)
        self.sizes = np.array([1 if p.type == BYTE else 0 if p.type == CONTROL else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.names = [str(i) for i in range(len(spec.pieces))]
        # Words stand alone where no piece goes on with the symbol for a space.
        self.by_word = (spec.trainer_spec.model_type == spec.trainer_spec.BPE and spec.normalizer_spec.escape_whitespaces and not kept
                        and not suffix and any(p.piece == SPACE for p in spec.pieces) and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.end = self.whole.eos_id()
        guards = (i for i, p in enumerate(spec.pieces) if p.type == NORMAL and SPACE not in p.piece)
        self.guard = next(guards)
        self.guard_size = len(spec.pieces[self.guard].piece)
        plain = spec.normalizer_spec
        plain.Clear()
        plain.name, plain.add_dummy_prefix, plain.remove_extra_whitespaces, plain.escape_whitespaces = "identity", False, False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        # Words and their ids in two generations: one met again moves to the younger.
        self.young, self.old = {}, {}
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _ids(self, normalised):
        """Ids of normalised text as an array."""
        text = normalised.decode()
        if not self.by_word:
            return np.array(self.bare.encode(text), np.int32)
        words = self.word.findall(text)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        known = self.young
        distinct = set(words).difference(known)
        again = [w for w in distinct if w in self.old]
        known.update((w, self.old[w]) for w in again)
        new = list(distinct.difference(again))
        ids = [array("i", i).tobytes() for i in self.bare.encode(new, num_threads=1)] if new else []
        known.update(zip(new, ids))
        out = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def windows(self, text):
        """(ids, begins, ends) of the pieces of each window, places in bytes of ``text``;
        the ends' own id is not among them. No piece: nothing."""
        cuts = [0]
        if len(text) > WINDOW and self.by_word and self.normalizer.windows_allowed():
            while (found := CUT.search(text, cuts[-1] + WINDOW)) is not None:
                cuts.append(found.start())
        cuts.append(len(text))
        for a, b in zip(cuts, cuts[1:]):
            data, origin = self.normalizer(text[a:b], a == 0, b == len(text))
            if not len(data):
                continue
            ids = self._ids(data.tobytes())
            to = np.cumsum(self.sizes[ids])
            if to[-1] != len(data):
                raise ValueError("pieces do not cover the normalised text")
            yield ids, a + origin[to - self.sizes[ids]], a + origin[to]

    def decoded(self, ids, first):
        """The text of a window's ids. Behind the first window a piece is put before them,
        as the library takes the space off what begins a text."""
        if first:
            return self.whole.decode(ids.tolist())
        return self.whole.decode([self.guard, *ids.tolist()])[self.guard_size:]


_MODELS = {}


def model(path):
    """The model of this worker process."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _source(docs):
    return pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))


def encode(docs, model_name=MODEL):
    """One row per document: doc_id, ids, begins, ends (arrays; bytes of the original UTF-8
    text, end exclusive). The end id comes last and covers nothing.

    A null or empty text has the end id alone. Ids are those of the library. Repeated
    rows give repeated rows, null ids stay null, an empty table gives no rows; other
    columns are not read."""
    plain = _source(docs)
    fields = [StructField("doc_id", plain.schema["doc_id"].dataType),
              StructField("ids", ArrayType(IntegerType(), False)), StructField("begins", ArrayType(LongType(), False)),
              StructField("ends", ArrayType(LongType(), False))]

    def run(batches):
        coder = model(model_file(model_name))
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                last = np.array([len(text)], np.int64)
                found = list(coder.windows(text)) + [(np.array([coder.end], np.int32), last, last)]
                arrays = [np.concatenate(c) for c in zip(*found)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for a in arrays]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *lists], names=[f.name for f in fields])

    return plain.mapInArrow(run, StructType(fields))


def decode(coded, model_name=MODEL):
    """doc_id and text of rows of ``encode``, as the library decodes the ids. Null ids
    give a null text."""
    plain = pick(coded, "doc_id", "ids")
    fields = [StructField("doc_id", plain.schema["doc_id"].dataType), StructField("text", StringType())]

    def run(batches):
        coder = model(model_file(model_name))
        for batch in batches:
            texts = [None if ids.as_py() is None else coder.whole.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return plain.mapInArrow(run, StructType(fields))


def digests(docs, model_name=MODEL):
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32.

    The ids of ``encode``, the text of ``decode`` and the spans (begin and end of every
    piece as little-endian 64-bit numbers, the end id's among them), each read window by
    window, so that a long text needs no more memory than a window beside itself. Nulls,
    empty texts, repeated rows and empty tables are as in ``encode``."""
    plain = _source(docs)
    schema = StructType([StructField("doc_id", plain.schema["doc_id"].dataType), StructField("n_tokens", LongType()),
                         StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
                         StructField("spans_crc32", LongType())])

    def digest(coder, text):
        n, of_ids, of_text, spans = 0, hashlib.sha256(), hashlib.sha256(), 0
        for ids, begins, ends in coder.windows(text):
            of_text.update(coder.decoded(ids, n == 0).encode())
            of_ids.update(" ".join(map(coder.names.__getitem__, ids.tolist())).encode() + b" ")
            spans = zlib.crc32(np.stack([begins, ends], 1).astype("<i8").tobytes(), spans)
            n += len(ids)
        of_ids.update(coder.names[coder.end].encode())
        spans = zlib.crc32(np.array([len(text)] * 2, "<i8").tobytes(), spans)
        return n + 1, of_ids.hexdigest(), of_text.hexdigest(), spans

    def run(batches):
        coder = model(model_file(model_name))
        for batch in batches:
            rows = [digest(coder, text.as_py() or b"") for text in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return plain.mapInArrow(run, schema)
