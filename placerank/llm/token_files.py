"""Token-id output: flat unsigned integer files and 64-bit document offsets, read back memory-mapped.

Documents are range-partitioned and sorted by id, each partition encodes its texts and writes

    part-00000.bin   token ids of its documents, one after the other, little-endian, in the narrowest
                     unsigned type that holds the vocabulary
    part-00000.idx   n + 1 little-endian unsigned 64-bit offsets into it, in tokens
    part-00000.doc   n little-endian signed 64-bit document ids (0 where the id is null)

and reports its counts. The counts (one row for each partition) are turned into bases by prefix sums,
so a document's place in the whole corpus is its partition's base plus its local offset.
A task writes under a name of its own and renames at the end, so a repeated task leaves one whole file.
"""

import json
import os
import re
import sys
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .common import cut, fresh, spread

COUNTS = "part int, n_docs long, n_null long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
CACHED_PIECE, CACHED_PIECES, JOINED = 48, 1_000_000, 256
#: Bytes and rows of texts that are encoded together.
BATCH, ROWS = 1 << 21, 2048
#: All white space but the space itself and the line feed.
_OTHER_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_cut = re.compile(r"(?<!\s) (?!\s)").split


def pieces_of(text: str | None) -> list:
    """Cut a text at each single line feed and each single space between two characters that are no white space (or an
    end): pieces behind a space stand alone, those behind a line feed begin with it, the first one is in a tuple, and None
    stands for the end. A text with other white space, or more of it in one place, is cut only at spaces."""
    if not text:
        return [None]
    white = [c for c in _OTHER_WHITE if c in text]
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == "\n" or text[-1] == "\n" or any(
            f" {c}" in text or f"{c} " in text or f"\n{c}" in text or f"{c}\n" in text for c in white):
        pieces = _cut(text)
    else:
        pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = (pieces[0],)
    pieces.append(None)
    return pieces


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece) -> int:
        self[piece] = out = len(self)
        return out


class PieceEncoder:
    """Encodes with a byte-level BPE of the tokenizers library, remembering what pieces gave.

    A single space between two characters that are no white space always begins a new pre-token of the byte-level split, and a
    single line feed there is one by itself, so a text may be cut at each and the pieces encoded alone. Only that
    makes remembering possible; all ids come from the library. New pieces without further white space are encoded many at a time
    and parted again at the tokens that they begin with. The distinct pieces of a batch are looked up once; at most
    CACHED_PIECES and what one batch brings are kept."""

    def __init__(self, tokenizer_file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max([*vocab.values(), end_id]) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        feed = self._encode("a\na")[1:-1]
        self.feed, self.fed = feed.tobytes(), np.zeros(len(self.spaced), bool)
        self.fed[feed] = len(feed) == 1
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, pieces: list[str], begins: np.ndarray) -> None:
        """Puts what new pieces give into `known`; each begins with a token of `begins`, and has none behind."""
        size, known = self.dtype.itemsize, self.known
        for lo in range(0, len(pieces), JOINED):
            some = pieces[lo:lo + JOINED]
            ids = self._encode("".join(some))
            at = np.flatnonzero(begins[ids]).tolist()
            if len(at) != len(some) or at[0]:
                known.update((p[p[0] == " ":], self._encode(p).tobytes()) for p in some)
                continue
            flat = ids.tobytes()
            known.update((p[p[0] == " ":], flat[a * size:b * size]) for p, a, b in zip(some, at, [*at[1:], len(ids)]))

    def _look_up(self, pieces: list) -> list[bytes]:
        """What each distinct piece of a batch gives."""
        known, texts = self.known, [p for p in pieces if p.__class__ is str]
        heads = {h: f"\n{h}" for h, in (p for p in pieces if p.__class__ is tuple) if h.split() == [h]}
        if len(known) > CACHED_PIECES:
            known.clear()
        new = {*texts, *heads.values()}.difference(known)
        fed = [p for p in new if p[:1] == "\n" and p[1:].split() == [p[1:]]]
        spaced = [f" {p}" for p in new if p.split() == [p] and p[:1] != "\n"]
        self._learn(fed, self.fed)
        self._learn(spaced, self.spaced)
        if len(fed) + len(spaced) < len(new):
            known.update((p, self._encode(f" {p}").tobytes()) for p in new if p not in known)
        skip, out = len(self.feed), []
        for p in pieces:
            if p.__class__ is str:
                out.append(known[p])
            elif p is None:
                out.append(self.end)
            else:
                out.append(known[heads[p[0]]][skip:] if p[0] in heads else self._encode(p[0]).tobytes() if p[0] else b"")
        for p in new:
            if len(p) > CACHED_PIECE:
                del known[p]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after the other, each with the end id, and how many each has."""
        number, cut_texts = _Numbers(), [pieces_of(t) for t in texts]
        index = np.fromiter(map(number.__getitem__, chain.from_iterable(cut_texts)), np.int64)
        found = self._look_up(list(number))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begin, many = np.cumsum(sizes) - sizes, sizes[index]
        through = np.cumsum(many)
        place = np.repeat(begin[index] - through + many, many) + np.arange(int(through[-1]) if len(through) else 0)
        ends = np.cumsum([len(c) for c in cut_texts]) - 1
        return np.frombuffer(b"".join(found), self.dtype)[place], np.diff(through[ends], prepend=0) if len(ends) else np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids (null: none) and the end id, as bytes."""
        ids, counts = self.encode(texts)
        ends = np.cumsum(counts).tolist()
        return [ids[b - n:b].tobytes() for n, b in zip(counts.tolist(), ends)]


def _encoder(tokenizer_file: str, end_id: int) -> PieceEncoder:
    """The worker process's encoder: what one task has learned serves the next."""
    kept = sys.modules["tokenizers"].__dict__.setdefault("_kept_encoders", {}) if "tokenizers" in sys.modules else {}
    key = (tokenizer_file, end_id)
    if key not in kept:
        own = PieceEncoder(tokenizer_file, end_id)
        kept = sys.modules["tokenizers"].__dict__.setdefault("_kept_encoders", {})
        kept[key] = own
    return kept[key]


def _write(path: str, id_col: str, text_col: str, tokenizer_file: str, end_id: int):
    def write(batches):
        part, encoder = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder, name = _encoder(tokenizer_file, end_id), f"_{part:05d}-{uuid.uuid4().hex}"
                store, root = fs.FileSystem.from_uri(path)
                store.create_dir(root)
                ids_file = store.open_output_stream(f"{root}/{name}.bin")
                offsets, doc_ids, n_null, n = [np.zeros(1, np.int64)], [], 0, 0
            for some in cut([batch], text_col, BATCH, ROWS):
                ids, counts = encoder.encode(some.column(text_col).to_pylist())
                ids_file.write(ids.tobytes())
                offsets.append(n + np.cumsum(counts))
                n += len(ids)
                own = some.column(id_col)
                doc_ids.append(own.fill_null(0).to_numpy())
                n_null += own.null_count
        if encoder is None:
            return
        ids_file.close()
        for suffix, values, kind in (("idx", offsets, "<u8"), ("doc", doc_ids, "<i8")):
            with store.open_output_stream(f"{root}/{name}.{suffix}") as out:
                out.write(np.concatenate(values).astype(kind).tobytes())
        for suffix in ("bin", "idx", "doc"):
            store.move(f"{root}/{name}.{suffix}", f"{root}/part-{part:05d}.{suffix}")
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "n_docs": sum(map(len, doc_ids)), "n_null": n_null, "n_tokens": n}],
            pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text and write the files under `path` (a folder that all executors share), in
    ascending order of ids, nulls first; rows with equal ids are ordered by the hash of their text and
    may share several partitions. A null text is an empty one; an empty table gives no parts. Other columns
    are ignored. Returns the manifest, which is also written as manifest.json: for each part its counts,
    `first_doc` and `base`, the numbers of documents and tokens before it."""
    salt = fresh(docs, "salt")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col, F.xxhash64(text_col).alias(salt))
    dealt = rows.repartitionByRange(spread(docs), F.col(id_col).asc_nulls_first(), salt)
    ordered = dealt.sortWithinPartitions(F.col(id_col).asc_nulls_first(), salt).select(id_col, text_col)
    counted = ordered.mapInArrow(_write(path, id_col, text_col, tokenizer_file, end_id), COUNTS).collect()
    manifest, first_doc, base = [], 0, 0
    for row in sorted(counted, key=lambda r: r["part"]):
        manifest.append(row.asDict() | {"first_doc": first_doc, "base": base})
        first_doc, base = first_doc + row["n_docs"], base + row["n_tokens"]
    encoder = PieceEncoder(tokenizer_file, end_id)
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": encoder.dtype.str, "parts": manifest}).encode())
    return [m | {"dtype": encoder.dtype.str} for m in manifest]


def _values(store, name: str, dtype: str) -> np.ndarray:
    """A flat file: mapped where it is a local or mounted one, else read through its store."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def _read(path: str):
    def read(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for m in batch.to_pylist():
                name = f"{root}/part-{m['part']:05d}"
                ids = _values(store, f"{name}.bin", m["dtype"])
                at = _values(store, f"{name}.idx", "<u8").astype(np.int64)
                doc_ids = _values(store, f"{name}.doc", "<i8")
                for lo in range(0, m["n_docs"], 10_000):
                    hi = min(lo + 10_000, m["n_docs"])
                    crc = [zlib.crc32(ids[at[i]:at[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None] * (min(hi, m["n_null"]) - lo) + doc_ids[max(lo, m["n_null"]):hi].tolist(),
                                 pa.int64()),
                        pa.array(m["base"] + at[lo:hi]), pa.array(at[lo + 1:hi + 1] - at[lo:hi]),
                        pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """One row for each document in the files: doc_id, start (tokens of all documents before it), n_tokens
    and the crc32 of its ids as 32-bit integers. Parts are read by separate tasks."""
    kinds = "part int, n_docs long, n_null long, n_tokens long, first_doc long, base long, dtype string"
    rows = [tuple(m[k.split()[0]] for k in kinds.split(", ")) for m in manifest]
    parts = spark.createDataFrame(rows, kinds).repartition(max(1, len(rows)))
    return parts.mapInArrow(_read(path), READ)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the documents' token files and return what is read back from them."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    return read_token_files(spark, path, write_token_files(docs, path, tokenizer_file, end_id))
