import math
import random
import re
from collections import Counter

import numpy as np

from helpers import DOCS, awkward_docs, clashing, frame, sentence
from placerank.llm import ranked_search as r

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    n = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    docs = awkward_docs() + [(200 + i, sentence(rng, rng.randint(1, 40)).replace("c", " "), "en", "s", 1) for i in range(150)]
    docs += [(400 + i, "the same few words", "en", "s", 1) for i in range(25)]
    pool = [d[1] for d in docs if d[1] and len(d[1]) < 2000]
    items = [(i, " ".join(rng.choices(rng.choice(pool).split(), k=8)).upper()) for i in range(20)]
    items += [(50, "SAME words words-few"), (51, None), (52, "?!"), (53, ""), (54, "unknownterm"), (None, pool[2]), (50, "SAME words words-few"),
              (50, pool[4]), (55, "x" * 30_000), (56, " ".join(pool[:6]))]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    table, asked = clashing(frame(spark, docs), "n", "terms", "rank"), clashing(frame(spark, items, ITEMS), "bag", "score")
    got = r.digest(table, asked).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    small = r.search(table, asked, k=3, block_bytes=900, postings=60).collect()
    assert sorted(map(tuple, small), key=repr) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    assert r.digest(frame(spark, [], DOCS), frame(spark, items, ITEMS)).collect() == []
    assert r.digest(frame(spark, docs), frame(spark, [], ITEMS)).collect() == []
    assert r.digest(frame(spark, [(1, None, None, None, None), (2, "?", "a", "b", 1)]), frame(spark, items, ITEMS)).collect() == []


def test_search_stops_early_and_sees_ties():
    """Of documents with falling impacts only the front of the lists is looked at; equal scores at the k-th place are all seen."""
    rng = np.random.default_rng(1)
    n = 20_000
    has = rng.random((3, n)) < 0.3
    has[:, :40] = True
    term, doc = np.nonzero(has)
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    tf = rng.geometric(0.5, len(term)) + 300 * (doc < 40)
    per_doc = np.bincount(doc, minlength=n)
    lengths = np.full(n, 50)
    weights = np.array([900, 1200, 300])
    shard = r.Shard(list(range(n)), lengths, term, tf, per_doc, weights, n, int(lengths.sum()))
    best = r.Best(10)
    looked = shard.search(np.array([0, 1, 2]), np.array([1, 2, 1]), best, step=4)
    scores = np.zeros(n, np.int64)
    for t, times in ((0, 1), (1, 2), (2, 1)):
        a, b = shard.edge[t], shard.edge[t + 1]
        scores[shard.doc[a:b]] += times * shard.impact[a:b]
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()))[:10]
    assert [(-s, i) for s, i in best.rows] == want
    assert looked < n // 4
    same = r.Shard(list(range(n))[::-1], np.full(n, 5), np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64), np.array([700]), n, 5 * n)
    best = r.Best(10)
    same.search(np.array([0]), np.array([1]), best)
    assert [i for _, i in best.rows] == list(range(10))
