"""What holds for every operator: odd values, repeated rows, clashing columns, no rows."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus  # noqa: E402
import corpus_pipeline  # noqa: E402
from flowgauge.llm import (html_paths, mixing, multiset_hash, outliers, packing, pseudo_lm, simhash, suffix_dedup,  # noqa: E402
                           warc, weak_pii)

OPERATORS = {
    "op2": lambda docs: packing.pack(packing.pieces(docs)).drop("sequence_id", "offset"),
    "op3": lambda docs: outliers.quality(docs).drop("distance2"),
    "op4": multiset_hash.fingerprinted,
    "op5": weak_pii.personal_data,
    "op6": mixing.mix,
    "op8": lambda docs: pseudo_lm.scored(docs).select("doc_id", "n_tokens"),
    "op9": simhash.near_duplicates,
    "op10": suffix_dedup.without_repeats,
}
FILTERS = [outliers.keep_good, simhash.keep_one, weak_pii.redacted, mixing.mixed]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = OPERATORS[name](corpus.frame(spark))
    extra = OPERATORS[name](corpus.frame(spark, extra=True, parts=2))
    assert plain.columns == extra.columns
    found = Counter(map(tuple, plain.collect()))
    assert found == Counter(map(tuple, extra.collect()))
    ids = Counter(r[0] for r in found.elements())
    assert set(ids) == {r[0] for r in corpus.documents()}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_and_only_null_rows(spark, name):
    assert OPERATORS[name](corpus.frame(spark, []).coalesce(1)).collect() == []
    nulls = OPERATORS[name](corpus.frame(spark, [(None,) * 5] * 3)).collect()
    assert len(nulls) == 3 and all(r[0] is None for r in nulls)


@pytest.mark.parametrize("how", FILTERS)
def test_stages_return_the_columns_they_get(spark, how):
    docs = corpus.frame(spark, extra=True)
    out = how(docs)
    assert out.columns == docs.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = out.collect()
    assert kept and all(tuple(r)[5:] == corpus.EXTRA_VALUES for r in kept)
    assert how(corpus.frame(spark, [], extra=True).coalesce(1)).collect() == []


def pages(spark, rows, extra=False):
    schema = "page_id long, url string, html string"
    if extra:
        return spark.createDataFrame([(*r, "x", 1, 2.0, "y") for r in rows], schema + ", text string, path int, host double, sha string").repartition(2)
    return spark.createDataFrame(rows, schema).repartition(2)


PAGES = [(1, "http://a.example/x", "<article><p>one &amp; two</p></article>"), (2, None, "<p>no host</p>"), (3, "not a url", None),
         (4, "http://a.example/y", ""), (5, "http://a.example/z", "<"), (1, "http://a.example/x", "<article><p>one &amp; two</p></article>"),
         (None, None, None), (7, "http://b.example", "<body>" + "<div>" * 300 + "deep" + "x" * 100_000)]


@pytest.mark.parametrize("operator", [html_paths.main_text, warc.archived])
def test_page_operators(spark, operator):
    plain, extra = operator(pages(spark, PAGES)), operator(pages(spark, PAGES, extra=True))
    assert plain.columns == extra.columns
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, extra.collect()))
    assert plain.count() == len(PAGES)
    assert operator(pages(spark, []).coalesce(1)).collect() == []


def test_pipeline(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "personal data", "source mix", "best-fit packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    odd = corpus.frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf_dir)
    assert odd.count() > 0
