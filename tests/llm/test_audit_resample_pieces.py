"""Filter audit, importance resampling and SentencePiece spans against brute force."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import corpus  # noqa: E402
from compare import difference, oracle  # noqa: E402
from flowgauge.llm import filter_audit, queries, resampling, sentence_pieces  # noqa: E402


@pytest.mark.parametrize("name", ["op11_failing_id_relations", "op12_bucketed_crc_resampling"])
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), oracle(sf_dir), queries.SQL[name]) is None


# --- filter audit ---

LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    firsts = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    seen = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": doc_id is not None and doc_id > firsts[text]}
        seen.append((source or "", {f for f, bad in fails.items() if bad}, doc_id in good, doc_id in toxic))
    want, sums = {}, Counter()
    for part in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                removed = [s for s in alive if f in s[1]]
                gone = [s for s in mine if f in s[1] and s[1] & set(order[:k])]
                alive = [s for s in alive if f not in s[1]]
                sums[part, f] += len(removed)
                want[part, "".join(order), k + 1] = [len(alive), len(removed), len(gone), sum(s[1] == {f} for s in mine),
                                                     sum(s[2] for s in removed), sum(s[3] for s in removed)]
    return {key: (*row, sums[key[0], key[1][key[2] - 1]]) for key, row in want.items()}


def audited(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def test_audit_is_that_of_walking_every_order(spark):
    rng = random.Random(5)
    rows = corpus.documents(n=60) + [(500 + i, corpus.prose(rng, 6) + " # 5 $", "en", "hot", 1) for i in range(6)]
    rows += [(None, "no id at all", "en", "a", 12), (700, "no id at all", "en", "", 12)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 80, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    want = brute_audit(rows, labels)
    marks = spark.createDataFrame(labels, LABELS)
    found = filter_audit.audit(corpus.frame(spark, rows), marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert audited(found) == want
    assert sum(v[2] for v in want.values()) and sum(v[3] for v in want.values()) and sum(v[4] for v in want.values())
    clashing = marks.selectExpr("*", "'x' as part", "1 as row", "2L as audited_row", "'A' as A")
    extra = corpus.frame(spark, rows, extra=True).selectExpr("*", "1 as row", "2 as part", "'q' as digest", "'z' as failed", "0 as A", "1 as good")
    assert audited(filter_audit.audit(extra, clashing)) == want


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(corpus.frame(spark, []).coalesce(1), none).collect() == []
    rows = audited(filter_audit.audit(corpus.frame(spark, [(None,) * 5] * 3), none))
    assert len(rows) == 600 and rows["", "ABCDE", 1] == (0, 3, 0, 3, 0, 0, 360)


def test_id_tables_hold_the_rows_that_fail(spark):
    rows = [(1, "same", None, "a", 4), (2, "same", None, "b", 4), (2, "same", None, "b", 4), (3, "#", None, "a", 1), (None, "same", None, "a", 4)]
    fails = filter_audit.failing_ids(filter_audit._marked(corpus.frame(spark, rows)))
    assert sorted(r.doc_id for r in fails["E"].collect()) == [2, 2]
    assert [r.doc_id for r in fails["D"].collect()] == [3]


# --- importance resampling ---

def brute_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, words + [a + b" " + b for a, b in zip(words, words[1:])]


def brute_resample(rows, target, least=20, percent=25):
    own, wanted = Counter(), Counter()
    for total, texts in ((own, [r[1] for r in rows]), (wanted, target)):
        for text in texts:
            total.update(zlib.crc32(f) % 10000 for f in brute_features(text)[1])
    s_all, t_all = sum(own.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text, *_ in rows:
        words, found = brute_features(text)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    ranked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(ranked[:percent * len(ranked) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.fixture(params=[1 << 21, 100])
def block(request, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", request.param)


def test_resample_is_that_of_counting_features(spark, monkeypatch):
    rng = random.Random(3)
    rows = corpus.documents(n=60) + [(800, "ÀÉ ABC-def 漢字x é" * 50, "en", "a", 1), (801, "z" * 30_000 + " end " + "y" * 300, "en", "a", 1)]
    target = [corpus.sentence(rng, 8) for _ in range(30)] + [None, "", "Story work a-b"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = brute_resample(rows, target)
    found = resampling.resample(corpus.frame(spark, rows), texts)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == want
    extra = corpus.frame(spark, rows, extra=True).selectExpr("*", "1 as n_features", "2 as weight", "'x' as enough", "3 as _down", "4 as _none")
    assert Counter(map(tuple, resampling.resample(extra, texts).collect())) == want
    assert resampling.resample(corpus.frame(spark, []).coalesce(1), texts).collect() == []
    assert Counter(map(tuple, resampling.resample(corpus.frame(spark, rows), texts.limit(0)).collect())) == brute_resample(rows, [])


@pytest.mark.parametrize("run", [1, 2, 3])
def test_blocks_lose_and_repeat_no_feature(block, run):
    rng = random.Random(run)
    texts = ["", None, "one", "Two wORDs", "é" * 300, "-" * 400 + "a b", "x" * 250 + " y " + "z " * 200]
    texts += [" ".join("".join(rng.choice("abé9 -Z") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    found = Counter()
    for first, data, begins, seen in resampling.blocks([None if t is None else t.encode() for t in texts], run):
        bucket, owner, _ = resampling.features(data, begins, seen, run, 1 << 31)
        found.update(zip((first + owner).tolist(), bucket.tolist()))
    want = Counter()
    for i, text in enumerate(texts):
        words = brute_features(text)[0]
        for n in range(1, run + 1):
            want.update((i, zlib.crc32(b" ".join(words[k:k + n])) % (1 << 31)) for k in range(len(words) - n + 1))
    assert found == want


def test_checksums_of_all_lengths():
    rng = random.Random(9)
    strings = [rng.randbytes(rng.choice([0, 1, 2, 3, 7, 7, 40, 1000])) for _ in range(3000)] + [b"\0" * 9]
    array = pa.array([b"first"] + strings, pa.large_binary())[1:]
    assert resampling.checksums(array).tolist() == [zlib.crc32(s) for s in strings]
    assert resampling.checksums(pa.array([], pa.large_binary())).tolist() == []


# --- sentence pieces ---

ODD = "aeb  \t\n▁é漢😀\x00ﬁ<>/s0é"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_file(sentence_pieces.MODEL))


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_ids_spans_and_texts_are_those_of_the_library(spark, library):
    docs = corpus.documents() + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(odd_texts(1, 400))]
    coded = sentence_pieces.encode(corpus.frame(spark, docs))
    rows = coded.collect()
    want = Counter((d, tuple(library.encode(t or "", add_eos=True))) for d, t, *_ in docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    texts = {d: t or "" for d, t, *_ in docs if d is not None}
    for r in rows:
        if r.doc_id is None:
            continue
        data = texts[r.doc_id].encode()
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data and r.begins == sorted(r.begins) and r.ends[-1] == len(data)
        for i, a, b in zip(r.ids, r.begins, r.ends):        # a piece of characters stands for the bytes that it spans
            if not library.is_byte(i) and not library.is_control(i) and a > 0:
                assert data[a:b].replace(b" ", "▁".encode()).decode() == library.id_to_piece(i)
    back = Counter((r.doc_id, r.text) for r in sentence_pieces.decode(coded).collect())
    assert back == Counter((d, library.decode(library.encode(t or "", add_eos=True))) for d, t, *_ in docs)


def brute_digest(library, doc_id, text):
    ids = library.encode(text or "", add_eos=True)
    return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_digests_of_whole_texts(spark, library):
    docs = corpus.documents() + [(1000, "漢字 " * 60_000 + "漢" * 300_000, "en", "a", 1), (1001, " " * 700_000 + "x y", "en", "a", 1),
                                 (1002, corpus.prose(random.Random(2), 400, 20), "en", "a", 1)]
    for extra in (False, True):
        found = sentence_pieces.digests(corpus.frame(spark, docs, extra=extra)).collect()
        assert Counter(tuple(r)[:4] for r in found) == Counter(brute_digest(library, d, t) for d, t, *_ in docs)
    assert sentence_pieces.digests(corpus.frame(spark, []).coalesce(1)).collect() == []
    coded = {r.doc_id: r for r in sentence_pieces.encode(corpus.frame(spark, docs)).collect()}
    for r in found:
        spans = np.stack([coded[r.doc_id].begins, coded[r.doc_id].ends], 1).astype("<i8") if r.doc_id is not None else None
        assert spans is None or zlib.crc32(spans.tobytes()) == r.spans_crc32


def test_whole_table(spark, sf_dir, library):
    found = queries.op13_offset_pieces(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter(brute_digest(library, r.doc_id, r.text) for r in table)


def test_windows_change_nothing(monkeypatch, library):
    coder = sentence_pieces.Model(sentence_pieces.model_file(sentence_pieces.MODEL))
    monkeypatch.setattr(sentence_pieces, "WINDOW", 30)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 20)
    for text in [" ".join(odd_texts(k, 5)) for k in range(60)] + [corpus.prose(random.Random(1))]:
        parts = list(coder.windows(text.encode()))
        ids = [i for p in parts for i in p[0].tolist()]
        assert ids == library.encode(text)
        assert "".join(coder.decoded(p[0], k == 0) for k, p in enumerate(parts)) == library.decode(ids)
        assert b"".join(text.encode()[a:b] for p in parts for a, b in zip(p[1].tolist(), p[2].tolist())) == text.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy, squeeze, escape", [(True, True, True), (False, False, False), (True, False, True), (False, True, False)])
def test_normaliser_and_alignment_are_those_of_the_library(rule, dummy, squeeze, escape):
    """Compiled character maps with rules in them, which the model at hand has not."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    proto = pb.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    spec = proto.normalizer_spec
    ours = sentence_pieces.Normalizer(spec)
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("aeA  \t\n▁é漢́　ｱﾞﬁ①½\xa0​\xadﷺ각") for _ in range(rng.randint(0, 25)))
        data, origin = ours(text.encode())
        want, places = theirs.normalize(text, with_offsets=True)
        assert data.tobytes().decode() == want
        starts = [*np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        assert [len(text.encode()[:origin[i]].decode()) for i in starts] == list(places)


def test_bytes_that_are_no_text(spark, library):
    bad = [b"a\xffb", b"\xe2\x82", b"\xe2\x82A\xc0\xaf", b"\xed\xa0\x80 x", b"\xf0\x9f\x98 y"]
    coder = sentence_pieces.Model(sentence_pieces.model_file(sentence_pieces.MODEL))
    for data in bad:
        ids = [i for p in coder.windows(data) for i in p[0].tolist()]
        assert ids == library.encode(data)


def test_a_model_without_byte_pieces_is_refused(library):
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        sentence_pieces.Model(proto=proto.SerializeToString())
