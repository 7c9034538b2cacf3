import random
import re

import numpy as np

from helpers import DOCS, awkward_docs, clashing, frame, sentence
from placerank.llm import components, minhash as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset()


def brute(rows):
    """(id, size, component) of each row, where equal sets are one class."""
    sets = [shingle_set(r[1]) for r in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            n = len(a & distinct[j])
            if 100 * n >= 80 * (len(a) + len(distinct[j]) - n):
                root[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(distinct)}
    least = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            least[at[s]] = min(r[0], least.get(at[s], r[0]))
    return sorted(((r[0], len(s), least.get(at[s]) if s else r[0]) for r, s in zip(rows, sets)), key=repr)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def corpus(seed=9, copies=60):
    rng = random.Random(seed)
    rows = awkward_docs() + [(100, "One", "en", "s", 1), (101, "one", "en", "s", 1), (102, "one two", "en", "s", 1), (103, "two one", "en", "s", 1)]
    base = [sentence(rng, 120) for _ in range(6)]
    # Edits on both sides of the limit, and one large group, in which many are linked through others only.
    rows += [(200 + i, edited(rng, base[i % 5], rng.randint(0, 9)), "en", "s", 1) for i in range(60)]
    rows += [(400 + i, edited(rng, base[5], rng.randint(0, 12)), "en", "s", 1) for i in range(copies)]
    passage = sentence(rng, 60)
    rows += [(600 + i, f"{sentence(rng, 30)} {passage} {sentence(rng, 10)}", "en", "s", 1) for i in range(30)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    table = clashing(frame(spark, rows), "node", "n", "tile", "key")
    want = brute(rows)
    for how in ({}, {"tile_rows": 8}, {"tile_shingles": 700}):
        got = m.near_duplicates(table, **how).collect()
        assert sorted(map(tuple, got), key=repr) == want
    kept = m.digest(table).where("kept").collect()
    assert {r.doc_id for r in kept} == {w[2] for w in want}


def test_buckets_of_unlike_classes(spark):
    """Classes that share only a few minhashes with the hub are still compared with each other, in any number of tiles."""
    rng = random.Random(2)
    passage = sentence(rng, 90)
    texts = [f"{sentence(rng, 60)} {passage}" for _ in range(80)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(100 + i, edited(rng, t, 4), "en", "s", 1) for i, t in enumerate(texts)]
    table = frame(spark, rows)
    got = m.near_duplicates(table, tile_rows=20).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    classes = spark.createDataFrame([(i, [1, 2, 3, i, 5, 6, 7, 8]) for i in range(40)], "node long, halves array<long>")
    ends = m.loose_links(classes, 4, 7).collect()
    assert {x for r in ends for x in r} == set(range(40))


def test_empty_tables_and_no_links(spark):
    assert m.digest(frame(spark, [], DOCS)).collect() == []
    rows = [(1, "a b c", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 1), (None, " ", "en", "s", 1)]
    got = m.digest(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)], key=repr)


def test_tables_find_pairs_as_often_as_stated():
    """Misses at similarity 0.8 are within the stated bound, and the half keys are few for many tables."""
    rng = np.random.default_rng(3)
    missed, n = 0, 1500
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = np.sort(x[:162]), np.sort(x[18:])
        h = m.half_keys([a, b], 2 * m.COLLECTION)
        same = h[0] == h[1]
        missed += not (same[:m.COLLECTION].any() and same[m.COLLECTION:].any())
    assert missed <= 2
    sizes = m._intersections([a, b[:50]], [b, a, a[:7]])
    assert sizes.tolist() == [[len(np.intersect1d(x, y)) for y in (b, a, a[:7])] for x in (a, b[:50])]


def test_no_table_of_many_rows_is_broadcast(spark, monkeypatch):
    """Exploded keys and signatures look small to Spark; joins with them are dealt out, however small they seem."""
    plans, stored = {}, m.stored

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    for module in (m, components):
        monkeypatch.setattr(module, "stored", noted)
    rows = [(i, " ".join(f"w{(i // 3 + j) % 50}" for j in range(40))) for i in range(60)]
    assert m.near_duplicates(frame(spark, rows, "doc_id long, text string")).count() == 60
    for name in ("starred", "compared", "rest", "edges"):
        assert plans[name] and not any("Broadcast" in p for p in plans[name]), name
