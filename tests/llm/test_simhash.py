import random
import re

import numpy as np
import xxhash

from helpers import awkward_docs, clashing, frame, sentence
from placerank.llm import components, simhash as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_groups(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                root[find(b)] = find(a)
    groups = {}
    for v in order:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def test_fingerprints_and_components(spark):
    rows = awkward_docs() + [(60 + i, awkward_docs()[1][1] + " " + sentence(random.Random(i), 2), "en", "a", 1) for i in range(8)]
    got = s.digest(clashing(frame(spark, rows), "fp", "root")).collect()
    assert len(got) == len(rows)
    fp = [fingerprint(r[1]) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r[0]), f"{f:016x}") for r, f in zip(rows, fp))
    ids = {}
    for r, f in zip(rows, fp):
        ids.setdefault(f, []).append(r[0])
    for group in brute_groups(set(fp)):
        known = [i for f in group for i in ids[f] if i is not None]
        assert {r.component_id for r in got if int(r.fingerprint, 16) in group} == {min(known, default=None)}


def test_tiled_links_connect_what_all_links_connect(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = {x ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & ((1 << 64) - 1) for x in seeds for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(300)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in signed + signed[:9] + [None]], "fp long")
    for tile in (8, 2048):
        roots = {r.fp: r.root for r in components.connected_components(s.links(table, tile=tile)).withColumnRenamed("node", "fp").collect()}
        groups = {}
        for v, u in zip(signed, np.array(signed, np.int64).view(np.uint64).tolist()):
            groups.setdefault(roots.get(v, v), set()).add(u)
        assert {frozenset(g) for g in groups.values()} == brute_groups(values)


def test_components_of_chains_and_circles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 251)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    docs = frame(spark, awkward_docs())
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute_groups({fingerprint(r[1]) for r in awkward_docs()})
    assert kept.count() == len(groups)
    assert s.one_of_each(frame(spark, [])).count() == 0 and s.digest(frame(spark, [])).count() == 0
