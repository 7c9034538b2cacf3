import collections
import re

import numpy as np

from helpers import awkward_docs, clashing, frame, sentence
from placerank.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, inside = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def texts():
    rng = __import__("random").Random(4)
    line = sentence(rng, 9)
    odd = ["a b c d e f g h", "a b c d e f g h " * 2, "\n".join([line] * 5), "x\n x\nx \nx", "a##b $ |é| <>", "\x0b\x0c\x1c\x85 é ü", " ".join("ab" * 40)]
    return odd + [r[1] for r in awkward_docs()]


def test_statistics_equal_brute_force():
    for some in (texts(), texts() * 2):
        got = q.statistics([None if t is None else t.encode() for t in some])
        assert [tuple(r[:5]) for r in got.tolist()] == [brute(t) for t in some]


def labelled(spark, n=300):
    rng = __import__("random").Random(9)
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(sentence(rng, rng.randint(5, 12)).capitalize() for _ in range(rng.randint(4, 12)))
        if i % 6 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 4 else " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "en", "a", len(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 6 != 0), 0))
    return rows, spark.createDataFrame(labels + [(None, 1, 0), (4, None, 0), (10**6, 0, 1)], "doc_id long, quality int, toxic int")


def test_forest_tells_junk_from_text_that_it_has_no_label_for(spark):
    rows, labels = labelled(spark)
    got = {r.doc_id: r for r in q.digest(clashing(frame(spark, rows), "n_words", "score"), labels).collect()}
    assert len(got) == len(rows)
    right = [got[i].kept == (i % 6 != 0) for i in range(len(rows)) if not got[i].base_failed]
    assert np.mean(right) > 0.97


def test_filter_and_awkward_rows(spark):
    rows, labels = labelled(spark)
    docs = clashing(frame(spark, rows + [(None, None, None, None, None), (900, "too short", "en", "a", 1), (901, "", "en", "a", 0)]), "n_words")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {None, 900, 901} and len(ids) > 200


def test_empty_tables(spark):
    rows, labels = labelled(spark, 40)
    none = labels.limit(0)
    assert q.digest(frame(spark, []), labels).count() == 0
    got = q.digest(frame(spark, rows), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
