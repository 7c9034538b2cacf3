import hashlib
import random
import re

from helpers import awkward_docs, clashing, frame, sentence
from placerank.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for item_id, item in items:
            v = split(item)
            for i in range(max(1, len(v) - 12) if v else 0):
                window = v[i:i + 13]
                for j in range(len(w) - len(window) + 1):
                    if w[j:j + len(window)] == window:
                        hit |= set(range(j, j + len(window)))
                        if item_id is not None:
                            ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(5)
    docs = [r[:2] for r in awkward_docs()]
    items = [(1, docs[0][1]), (10, " ".join(docs[1][1].split()[5:20])), (2, " ".join(docs[2][1].upper().split()[7:15])), (3, None), (4, ""),
             (5, "no"), (5, "no id"), (None, " ".join(docs[3][1].split()[:13])), (1, docs[0][1]), (6, sentence(rng, 40)), (7, "x" * 30_000), (8, "é")]
    docs += [(50, sentence(rng, 300) + " " + " ".join(docs[1][1].split()[5:18])), (51, "no no no"), (52, "é É ß")]
    return docs, items


def run(spark, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = d.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), table)
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = tables()
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = tables()
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "runs", "items")
    found, names = d.find_contamination(table, spark.createDataFrame(items, "item_id long, text string"), block_words=4000)
    whole, own = d.find_contamination(table, spark.createDataFrame(items, "item_id long, text string"))
    pick = lambda f, n: sorted(map(str, f.select("doc_id", "text", *n.values()).collect()))
    assert names["runs"] != "runs" and pick(found, names) == pick(whole, own)


def test_empty_tables_and_filter(spark):
    docs, items = tables()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])
    frame_ = frame(spark, awkward_docs())
    clean = d.clean_documents(frame_, spark.createDataFrame(items, "item_id long, text string"))
    bad = {r[0] for r in brute([r[:2] for r in awkward_docs()], items) if r[-1]}
    assert clean.columns == frame_.columns and 0 in bad and not bad & {r.doc_id for r in clean.collect()} - {None, 6}
