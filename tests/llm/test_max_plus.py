import pickle
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from helpers import awkward_docs, clashing, frame, sentence
from placerank.llm import max_plus as m

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return m.Pieces(FILE)


def best_score(pieces, text):
    """Plain dynamic programming over all substrings."""
    best = [0] + [m.NEVER] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.reach), j):
            k = pieces.ids.get(text[i:j])
            if k is not None:
                best[j] = max(best[j], best[i] + pieces.values[k])
        if text[j - 1:j] not in pieces.ids:
            best[j] = max(best[j], best[j - 1] + pieces.unknown)
    return best[-1]


def cases():
    rng = random.Random(1)
    odd = ["", " ", "a  b   c", "漢字 x", "x\ty\n  z", "▁literal▁", "thisisaverylong" * 8, " é", "    "]
    return odd + ["".join(rng.choice("abthe  in漢\n▁") for _ in range(rng.randint(1, 150))) for _ in range(60)]


def test_scores_and_round_trip(pieces):
    for text in cases():
        ids, score = pieces.solve(m._written(text))
        assert score == best_score(pieces, m._written(text)) and pieces.decode(ids) == text


def test_words_together_as_alone(pieces):
    words = [w for t in cases() for w in (t.split(" ") + [t[:60]])] + ["x" * 64, "漢字", "", "a漢b字c", "\ue000\ue001"]
    words = [f" {w}" for w in words if len(w) < 64] + ["x", "漢"]
    ids, counts, scores = pieces.solve_words(words)
    ends = np.cumsum(counts)
    for w, a, b, score in zip(words, ends - counts, ends, scores.tolist()):
        assert (ids[a:b].tobytes(), score) == pieces.word(w)
    copy = pickle.loads(pickle.dumps(pieces))
    assert [x.tolist() for x in copy.solve_words(words)] == [ids.tolist(), counts.tolist(), scores.tolist()]


def test_chunks_begin_between_words():
    text = " aa bb  ccccccccccc d"
    assert m.starts_of(text, 4, True) == [0, 3, 6, 11, 15, 19, 21] or m.starts_of(text, 4, True)[-1] == len(text)
    for size in (1, 3, 4, 7, 100):
        for cuts in (True, False):
            at = m.starts_of(text, size, cuts)
            assert at[0] == 0 and at[-1] == len(text) and all(0 < b - a <= size for a, b in zip(at, at[1:]))
    assert m.starts_of("", 4, True) == [0]


def test_words_get_the_librarys_best_segmentation(pieces):
    """The library's own lattice (its n-best list), with the model read as a unigram model. Its sums are single floats,
    so only short texts of known characters are compared, by their scores."""
    data = bytearray(open(FILE, "rb").read())
    at = next(i for i in range(len(data) - 3, 0, -1) if data[i] == 0x18 and data[i + 1] == 2 and _loads(data, i + 1))
    data[at + 1] = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12)))
        first = library.nbest_encode_as_pieces(word, 2)[0]
        own = np.frombuffer(pieces.solve(m._written(word))[0], "<i4").tolist()
        assert sum(pieces.values[library.piece_to_id(p)] for p in first) == sum(pieces.values[i] for i in own)


def _loads(data, at):
    """Whether setting this byte to 1 makes the model a unigram one: it then has an n-best list."""
    old, data[at] = data[at], 1
    try:
        return bool(sentencepiece.SentencePieceProcessor(model_proto=bytes(data)).nbest_encode_as_pieces("ab", 2))
    except Exception:
        return False
    finally:
        data[at] = old


def test_matrices_are_associative_and_chunks_give_the_whole(pieces):
    rng = random.Random(2)
    for text in cases():
        whole, size = m._written(text), rng.choice([1, 3, 7, 16, 17, 40])
        if not whole:
            continue
        parts = [whole[s:s + size + pieces.reach - 1] for s in range(0, len(whole), size)]
        sizes = [len(whole[s:s + size]) for s in range(0, len(whole), size)]
        found = [pieces.matrix(p, n) for p, n in zip(parts, sizes)]
        left = right = None
        for a in found:
            left = a if left is None else m.product(left, a)
        for a in reversed(found):
            right = a if right is None else m.product(a, right)
        reach = left > m.NEVER // 2
        assert (left == right)[reach].all() and left[0, 0] == best_score(pieces, whole)
        rows = pa.Table.from_pylist([{"key": "k", "nth": i, "n": len(found), "m": a.tobytes()} for i, a in enumerate(found)])
        states = sorted(m._descend(rows, pa.table({"enter": [0], "leave": [0]})).to_pylist(), key=lambda r: r["nth"])
        traced = [pieces.between(p, n, r["enter"], r["leave"]) for p, n, r in zip(parts, sizes, states)]
        assert sum(s for _, s in traced) == left[0, 0] and pieces.decode(b"".join(i for i, _ in traced)) == text


def test_tables(spark, pieces):
    rows = awkward_docs() + [(80, "漢" * 900, "zh", "a", 1), (81, sentence(random.Random(4), 700), "en", "a", 1)]
    docs = clashing(frame(spark, rows), "ids", "key", "nth")
    ids = {}
    for chunk in (m.CHUNK, 50):
        encoded, names = m.encode(docs, FILE, chunk=chunk)
        got = m.decode(encoded, FILE, names["ids"], "decoded").collect()
        assert names["ids"] != "ids" and len(got) == len(rows)
        for r in got:
            assert r.decoded == (r.text or "") and r[names["score"]] == best_score(pieces, m._written(r.text or ""))
            # Texts whose words are shorter than a chunk get the same ids whatever the chunk.
            if max(map(len, (r.text or "").split(" "))) < 40:
                assert ids.setdefault(r.text, r[names["ids"]]) == r[names["ids"]]
    assert m.digest(frame(spark, []), FILE).count() == 0
