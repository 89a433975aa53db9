"""Documents to training sequences, stage by stage."""

from flowgauge.llm import mixing, outliers, packing, simhash, weak_pii
from flowgauge.llm.shared import table
from flowgauge.session import stored


def quality_rules(spark, docs, sf_dir):
    return outliers.keep_good(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def personal_data(spark, docs, sf_dir):
    return weak_pii.redacted(docs)


def source_mix(spark, docs, sf_dir):
    return mixing.mixed(docs)


def best_fit_packing(spark, docs, sf_dir):
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

# Robust estimates, components and tokenizers are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to ``documents`` in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
