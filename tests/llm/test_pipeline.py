"""The pipeline's stages one by one against plain versions, each on its own input."""

import numpy as np

import corpus_pipeline
from placerank.llm import max_plus, pii
from placerank.llm.common import stored, table
from placerank.llm.queries import PII_KEY, QUERIES
from test_decontaminate import brute as brute_contamination
from test_max_plus import FILE
from test_quality import brute as brute_statistics
from test_simhash import brute_groups, fingerprint

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen, columns = rows(docs), docs.columns
    verdict = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{k}")
        now = rows(docs)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            for i, r in seen.items():
                n, *_, repeated = brute_statistics(r.text)
                assert not (i in now and (n < 20 or 100 * repeated > 30 * n))
            assert set(now) == {i for i, kept in verdict.items() if kept}
        if k == 1:
            fp = {i: fingerprint(r.text) for i, r in seen.items()}
            groups = brute_groups(set(fp.values()))
            assert set(now) == {min(i for i in fp if fp[i] in g) for g in groups}
        if k == 2:
            bad = brute_contamination([(i, r.text) for i, r in seen.items()], [tuple(r) for r in table(spark, SF, "benchmark").collect()])
            assert set(now) == {r[0] for r in bad if not r[-1]}
        if k == 3:
            names = pii.Pseudonyms(PII_KEY)
            assert {i: r.text for i, r in now.items()} == {i: pii.pseudonymise(r.text, names, {}) for i, r in seen.items()}
        if k == 4:
            whole = max_plus.Pieces(FILE)
            for i, r in now.items():
                assert r.decoded == seen[i].text
                assert r.score == whole.solve(max_plus._written(r.text))[1]
        seen = now
    last = rows(corpus_pipeline.run(spark, SF))
    assert {i: r.ids for i, r in last.items()} == {i: r.ids for i, r in seen.items()}


def test_labels_are_respected(spark):
    """Of the labelled rows hardly a good one is lost to the forest, and most bad ones are."""
    kept = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    good = [kept[i].kept for i, q in labels.items() if q == 1 and not kept[i].base_failed]
    bad = [kept[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
