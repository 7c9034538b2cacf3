import hashlib
import zlib

from pyspark.sql import functions as F

from helpers import DOCS, awkward_docs, clashing, frame
from placerank.llm import merkle as m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def levels(digests, fanout):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(tree, at, fanout):
    """Steps of (left, right) digests."""
    steps = []
    for level in tree[:-1]:
        a = at // fanout * fanout
        steps.append((level[a:at], level[at + 1:a + fanout]))
        at //= fanout
    return steps


def folded(digest, steps):
    for left, right in steps:
        digest = sha("".join([*left, digest, *right]))
    return digest


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in names], fanout)
    out, root = [], top[-1][0]
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = proof(trees[g], i, fanout) + proof(top, k, fanout)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = folded(leaf((*r[:4], r[4] + 1)) if bad else leaf(r), steps)
            out.append((r[0], leaf(r), trees[g][-1][0], root, sha("".join(d for s in steps for x in s for d in x)), end, end == root))
    return sorted(out, key=repr)


def check(spark, rows, **how):
    got = m.digest(clashing(frame(spark, rows), "group", "lo", "digest", "at"), **how).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, how.get("fanout", 2))
    return got


def test_awkward_rows_and_bands(spark):
    rows = awkward_docs() + [(100 + i, f"text {i}", "fr" if i % 3 else "ü", "s", i) for i in range(90)]
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False}
    for how in ({"band": 1}, {"band": 3}, {"fanout": 3, "band": 2}, {"fanout": 5, "band": 1}):
        check(spark, rows, **how)


def test_small_trees(spark):
    rows = [(7, "a", "en", "s", 1)]
    check(spark, rows)
    check(spark, rows + [(8, "b", "de", "s", None)])
    check(spark, [(i, "same", None, None, 3) for i in (1, 1, 1, 2, None, None)])
    assert m.digest(frame(spark, [], DOCS)).collect() == []


def test_ranks_are_dense_and_paths_refuse_what_is_missing(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("group"), (F.col("id") % 90).alias("k"),
                                   F.col("id").alias("v"))
    got = m.ranked(rows.repartition(7), [F.col("k"), F.col("v")]).collect()
    for g in "xy":
        own = sorted((r for r in got if r.group == g), key=lambda r: (r.k, r.v))
        assert [r.lo for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    path = bytes([1, 0]) + b"a" * 32 + bytes([0, 0]) + bytes([0, 2]) + b"b" * 32 + b"c" * 32
    assert m.siblings(path) == [([b"a" * 32], []), ([], []), ([], [b"b" * 32, b"c" * 32])]
