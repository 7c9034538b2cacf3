import collections
import math
import zlib

import numpy as np

from helpers import awkward_docs, clashing, frame
from placerank.llm import ngram_filter as g


def brute(rows):
    words = [((r[1] or "").encode().lower().split() + [b"\n"], r[0]) for r in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = collections.Counter(w for ws, i in words if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted((str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws, i in words)


def test_base_scores_equal_brute_force(spark):
    rows = awkward_docs()
    for chunk in (1 << 20, 500):
        got = g.score_texts(clashing(frame(spark, rows), "chunk", "tokens"), filter_bits=1 << 20, chunk=chunk).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)
        assert all(r.score < 0 for r in got)


def test_filter_returns_levels_of_what_it_holds_and_mostly_zero_else():
    rng = np.random.default_rng(1)
    keys = g.mix(rng.integers(1 << 63, size=4000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, 4000), 10**9)
    regions, bits = 4, 1 << 18
    own = (keys >> np.uint64(62)).astype(int)
    parts = [g.region_bits(keys[own == r], counts[own == r], bits // regions) for r in range(regions)]
    filled = g.CountFilter(np.frombuffer(b"".join(parts), np.uint8), regions)
    exact = g.levels(counts)
    assert (filled.level(keys) >= exact).all() and (filled.level(keys) == exact).mean() > 0.97
    other = g.mix(rng.integers(1 << 63, size=4000, dtype=np.uint64))
    assert (filled.level(other) > 0).mean() < 0.03
    ratio = g.ESTIMATES[exact] / counts
    assert 0.65 < ratio.min() and ratio.max() < 1.5


def test_seen_word_pairs_score_higher(spark):
    text = " ".join(f"w{i * 7 % 11}" for i in range(60))
    rows = [(i, text, "en", "a", 1) for i in range(30)] + [(100, " ".join(reversed(text.split())), "en", "a", 1)]
    got = {r.doc_id: r.score for r in g.score_texts(frame(spark, rows), filter_bits=1 << 20).collect()}
    assert got[0] > got[100] + 10


def test_empty(spark):
    assert g.score_texts(frame(spark, []), filter_bits=1 << 20).count() == 0


def test_filter_grows_with_what_is_counted(spark):
    rng = np.random.default_rng(4)
    counts = np.minimum(rng.zipf(1.7, 50_000), 10**6)
    keys, other = (g.mix(rng.integers(1 << 63, size=50_000, dtype=np.uint64)) for _ in range(2))
    bits = g.region_bits(keys, counts, g.bits_for(counts, 64))
    assert (g.CountFilter(np.frombuffer(bits, np.uint8), 1).level(other) > 0).mean() < 0.04
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(300, size=200)), "en", "a", 1) for i in range(80)]
    words = {i: [b"\n", *text.encode().split(), b"\n"] for i, text, *_ in rows}
    word, pair = collections.Counter(), collections.Counter()
    for i, w in words.items():
        if not g.held_out(i):
            word.update(w[1:])
            pair.update(zip(w, w[1:]))
    n, v = word.total(), len(word)
    likely = {i: sum(math.log10((min(g.ESTIMATES[g.levels(np.array(pair[a, b]))], word[a]) + g.PRIOR * (word[b] + 1) / (n + v + 1))
                                / (word[a] + g.PRIOR)) for a, b in zip(w, w[1:])) for i, w in words.items()}
    got = {r.doc_id: r.score for r in g.score_texts(frame(spark, rows), filter_bits=1 << 12).collect()}
    assert got.keys() == likely.keys() and all(abs(got[i] / likely[i] - 1) < 0.05 for i in got)
