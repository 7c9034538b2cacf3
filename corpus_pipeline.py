"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

import public_tokenizers

from placerank.llm import decontaminate, max_plus, pii, quality, simhash
from placerank.llm.common import stored, table
from placerank.llm.queries import PIECES, PII_KEY


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the fixed limits and the forest."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """All documents, with pseudonyms for personal data."""
    return pii.replace_personal_data(docs, PII_KEY)


def pieces(spark, docs, sf_dir):
    """The columns of documents with each text's ids, their number and score, and the text decoded from the ids."""
    path = public_tokenizers.path(PIECES)
    return max_plus.encode(docs, path, check=True)[0]


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("pieces", pieces),
]
#: A forest, a max-plus scan and keyed permutations have no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """What the last stage returns for the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
