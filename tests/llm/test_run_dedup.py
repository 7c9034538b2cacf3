import hashlib
import random

import numpy as np
import pytest

from helpers import awkward_docs, clashing, frame
from placerank.llm import run_dedup as d
from placerank.llm.run_index import RunIndex


@pytest.mark.parametrize("seed", range(40))
def test_index_finds_the_first_place_of_each_window(seed):
    rng = random.Random(seed)
    letters, window = rng.choice([b"ab", b"abc\x00\xff"]), rng.choice([1, 2, 3, 5, 8, 10])
    base = bytes(rng.choice(letters) for _ in range(40))
    texts = [base[i:i + rng.randint(window, 20)] for i in (rng.randint(0, 20) for _ in range(12))]
    texts += [bytes(rng.choice(letters) for _ in range(rng.randint(window, 15))) for _ in range(5)]
    texts = [t for t in dict.fromkeys(texts) if len(t) >= window]
    index, first, got = RunIndex(texts, window), {}, {}
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i:i + window], index.starts[k] + i)
    for done, live, at in index.matching_statistics(texts):
        got |= {(int(k), len(texts[k]) - done): a for k, a in zip(live, at)}
    assert got == {(k, i): first[t[i:i + window]] for k, t in enumerate(texts) for i in range(len(t) - window + 1)}


def test_runs_shrink_with_repetition():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(500))
    index = RunIndex([text[:400 + i] for i in range(50)], 100)
    assert len(index.run_row) < 1500 < 50 * 400


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if b[i:i + window] in seen:
                gone[i:i + window] = True
            seen.add(b[i:i + window])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdé ") for _ in range(260))
    out = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 300))) + shared[rng.randint(0, 80):rng.randint(150, 260)] + "end" * rng.randint(0, 60))
           for i in range(40)]
    return out + [(100 + i, r[1]) for i, r in enumerate(awkward_docs()) if r[1] != "x" * 30_000] + [(200, None), (201, ""), (202, "x" * 3000), (203, "xy" * 900), (204, shared), (205, shared)]


@pytest.mark.parametrize("chunk", [1 << 22, 700])
def test_equals_brute_force(spark, chunk):
    docs = clashing(spark.createDataFrame(rows(), "doc_id long, text string").repartition(4), "chunk", "region", "kept")
    got = d.remove_repeats(docs, chunk=chunk, index_bytes=500 if chunk < 1000 else 1 << 18).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows(), 100)


def test_null_and_equal_ids_and_empty_tables(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef") for _ in range(150))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (1, "no")], "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_removed) for r in d.remove_repeats(docs).collect())
    assert got == [("1", 0), ("3", 0), ("3", 150), ("None", 150)]
    assert d.digest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [60, 95])
def test_a_line_with_other_neighbours_each_time_fills_no_index(spark, monkeypatch, length):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = word(length), word(200)
    docs = [(i, word(150) + line + word(150) + (passage if i % 9 == 0 else "")) for i in range(300)]
    sizes, marks = [], d._marks
    monkeypatch.setattr(d, "_marks", lambda pieces, *a: sizes.append(sum(map(len, pieces))) or marks(pieces, *a))
    cut, mark = d._cut(8, 100, 40), d._mark(100, 4000)
    chunks = [{"chunk": c, "doc_ids": [i for i, _ in docs[c::10]], "sizes": [len(t) for _, t in docs[c::10]],
               "data": d._squeeze("".join(t for _, t in docs[c::10]).encode())} for c in range(10)]
    asked = [r for b in d._ask(8, 100, 40)([d.pa.RecordBatch.from_pylist(chunks)]) for r in b.to_pylist()]
    tell = d._tell(20) if "counts" in asked[0] else d._tell
    known = [r for k in range(8) for r in tell(d.pa.Table.from_pylist([a for a in asked if a["region"] == k])).to_pylist()]
    pieces = [r for c in chunks for r in cut(d.pa.Table.from_pylist([c]), d.pa.Table.from_pylist(
        [k for k in known if k["chunk"] == c["chunk"]])).to_pylist()]
    for k in range(8):
        if own := [p for p in pieces if p["region"] == k]:
            mark(d.pa.Table.from_pylist(own, d._PIECES))
    assert 0 < max(sizes) < 20_000
    frame_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = d.remove_repeats(frame_, chunk=5000, index_bytes=1000).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(docs, 100)
