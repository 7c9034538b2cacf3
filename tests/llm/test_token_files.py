import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import awkward_docs, clashing, frame
from placerank.llm import token_files as t

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_pieces_give_the_librarys_ids(library):
    rng, encoder = random.Random(1), t.PieceEncoder(FILE, 2)
    texts = ["", " ", "  a  b\n c \n \n d\t e  ", "a <|endoftext|> b", "x<|endoftext|>y z", "\x1c a   b \x85 c", " lead", "trail ",
             "don't can't 's", "\n \nb  \n  c", "\u00a0 x \u3000 y", "a" * 5000]
    texts += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "漢", "1", ".", "'s", "\u00a0", "\t"]) for _ in range(60)) for _ in range(400)]
    for _ in range(2):
        for text, ids in zip(texts, encoder(texts)):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_files_and_what_is_read_back(spark, tmp_path, library):
    docs = clashing(frame(spark, awkward_docs()), "salt", "start", "part")
    path = f"file://{tmp_path}/tokens"
    manifest = t.write_token_files(docs, path, FILE, 2)
    rows = t.read_token_files(spark, path, manifest).collect()
    rows.sort(key=lambda r: r.start)
    expected = [(d[0], library.encode(d[1] or "", add_special_tokens=False).ids + [2]) for d in awkward_docs()]
    key = lambda d: (d[0] is not None, d[0] or 0)
    assert [r.doc_id for r in rows] == [d[0] for d in sorted(expected, key=key)]
    assert sorted((key(r), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (key(d), len(d[1]), zlib.crc32(np.array(d[1], "<u4").tobytes())) for d in expected)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    whole = json.load(open(f"{tmp_path}/tokens/manifest.json"))
    assert sum(p["n_tokens"] for p in whole["parts"]) == sum(r.n_tokens for r in rows)
    for p in whole["parts"]:
        name = f"{tmp_path}/tokens/part-{p['part']:05d}"
        assert os.path.getsize(name + ".bin") == np.dtype(whole["dtype"]).itemsize * p["n_tokens"]
        assert np.fromfile(name + ".idx", "<u8")[-1] == p["n_tokens"]


def test_empty_table(spark, tmp_path):
    manifest = t.write_token_files(frame(spark, []), str(tmp_path), FILE, 2)
    assert manifest == [] and t.read_token_files(spark, str(tmp_path), manifest).count() == 0
