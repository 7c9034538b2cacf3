"""Language-model scores from a log-frequency Bloom filter.

Counts of word pairs of the training texts are quantised on a logarithmic scale; a pair of level j is put into a Bloom
filter together with each of 1..j, and its level is read back by probing 1, 2, ... until one is missing. The filter is split
into regions by the leading bits of the pair's hash, so each region is built by one group of the counting shuffle and no
bits have to be merged. A region has at least ROOM bits for each level of each pair counted there, so a probe for a missing
one passes with at most about 0.03, whatever the corpus.

The filter is a stored table and is never gathered. Tokens are known by their 64-bit XXH3. Chunks of documents ask region by
region for their distinct tokens and pairs, and get back the tokens' exact training counts and the pairs' levels."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import power_of_two, spread, stored, texts
from .packing import pack, pack_sorted, unpack, unpack_sorted

FILTER_BITS, ROOM, PROBES, LOG_BASE, PRIOR, CHUNK = 1 << 29, 8, 3, 1.5, 20.0, 4 << 20
HELD_OUT, FOLDS = 2, 7
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_32, _29 = np.uint64(32), np.uint64(29)
#: Pairs that are probed at once.
_BLOCK = 1 << 20
#: A level's n-grams are taken to have the mean of the counts that it stands for.
LEVELS = 70
_edges = np.ceil(LOG_BASE ** np.arange(LEVELS + 1))
ESTIMATES = np.concatenate(([0.0], (_edges[:-1] + np.maximum(_edges[1:] - 1, _edges[:-1])) / 2))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _B
    x = (x ^ (x >> _29)) * _C
    return x ^ (x >> _32)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_edges, counts, "right")


def _positions(keys: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    h = mix(keys ^ np.uint64(level * int(_A) % (1 << 64)))
    # Double hashing with both halves: room for regions of up to 2^32 bits.
    step = (h >> _32) | np.uint64(1)
    return [(h + step * np.uint64(i)) & np.uint64(bits - 1) for i in range(PROBES)]


def bits_for(counts: np.ndarray, least: int) -> int:
    """How many bits a region needs for n-grams with these counts."""
    return power_of_two(max(ROOM * int(levels(counts).sum()), least, 64))


def region_bits(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A region of the filter that holds these n-grams."""
    on, level = np.zeros(bits, bool), levels(counts)
    for j in range(1, int(level.max(initial=0)) + 1):
        for pos in _positions(keys[level >= j], j, bits):
            on[pos] = True
    return np.packbits(on, bitorder="little").tobytes()


class CountFilter:
    def __init__(self, bits: np.ndarray, regions: int):
        self.bits, self.size = bits, len(bits) * 8 // regions
        self.shift = np.uint64(64 - (regions.bit_length() - 1))

    def level(self, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        start = (keys >> self.shift if self.shift < 64 else np.zeros(len(keys), np.uint64)) * np.uint64(self.size // 8)
        for j in range(1, LEVELS + 1):
            some, at = keys[live], start[live]
            here = np.ones(len(live), bool)
            for pos in _positions(some, j, self.size):
                byte = self.bits[at + (pos >> np.uint64(3))]
                here &= (byte >> (pos & np.uint64(7)).astype(np.uint8)) & 1 > 0
            live = live[here]
            if not len(live):
                break
            out[live] = j
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        return ESTIMATES[self.level(keys)]


def tokens(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by the end token, and where each begins. A null text is empty."""
    from xxhash import xxh3_64_digest

    end, parts, sizes = xxh3_64_digest(b"\n"), [], []
    for text in batch:
        words = text.lower().split() if text else []
        parts += map(xxh3_64_digest, words)
        parts.append(end)
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _pairs(code: np.ndarray) -> np.ndarray:
    """A hash for each token and the one before; every text begins behind an end token."""
    before = np.empty_like(code)
    before[1:] = code[:-1]
    if len(code):
        before[0] = code[-1]
    return mix(before * _A + code)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _chunks(batches, size: int):
    """(ids, texts) of some documents, about `size` bytes together."""
    ids, some, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
            ids.append(doc_id)
            some.append(text)
            n += len(text or b"") + 16
            if n >= size:
                yield ids, some
                ids, some, n = [], [], 0
    if ids:
        yield ids, some


def _by_region(keys: np.ndarray, regions: int) -> np.ndarray:
    """Where each region begins among ascending keys."""
    step = (1 << 64) // regions
    return np.searchsorted(keys, np.array([i * step for i in range(regions)], np.uint64)).tolist() + [len(keys)]


def _count(regions: int, chunk: int):
    def run(batches):
        for ids, some in _chunks(batches, chunk):
            code, _ = tokens([t for i, t in zip(ids, some) if not held_out(i)])
            found = [np.unique(x, return_counts=True) for x in (code, _pairs(code))]
            rows = []
            cuts = [_by_region(keys, regions) for keys, _ in found]
            for r in range(regions):
                row = {"region": r}
                for name, (keys, n), cut in zip(("word", "pair"), found, cuts):
                    at = slice(cut[r], cut[r + 1])
                    row |= {name: pack_sorted(keys[at]), f"{name}_n": pack(n[at].astype(np.uint32))}
                if cuts[0][r] < cuts[0][r + 1] or cuts[1][r] < cuts[1][r + 1]:
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _COUNTED)

    return run


_COUNTED = pa.schema([("region", pa.int32()), *[(n, pa.binary()) for n in ("word", "word_n", "pair", "pair_n")]])
_BUILT = pa.schema([("region", pa.int32()), ("bits", pa.binary()), ("word", pa.binary()), ("word_n", pa.binary()),
                    ("n", pa.int64()), ("v", pa.int64())])


def _merge(group: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack_sorted(x) for x in group.column(name).to_pylist()])
    n = np.concatenate([unpack(x, np.uint32) for x in group.column(f"{name}_n").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _build(least: int):
    def run(group: pa.Table) -> pa.Table:
        (words, word_n), (pairs, pair_n) = _merge(group, "word"), _merge(group, "pair")
        bits = region_bits(pairs, pair_n, bits_for(pair_n, least))
        return pa.Table.from_pylist([{
            "region": group.column("region")[0].as_py(), "bits": pack(np.frombuffer(bits, np.uint8)), "word": pack_sorted(words),
            "word_n": pack(word_n), "n": int(word_n.sum()), "v": len(words)}], _BUILT)

    return run


def count_ngrams(docs: DataFrame, regions: int, filter_bits: int = FILTER_BITS, chunk: int = CHUNK) -> DataFrame:
    """Stored rows by region: filter bits, exact word counts, sums. Counts are combined by chunk before the shuffle."""
    counted = docs.mapInArrow(_count(regions, chunk), "region int, word binary, word_n binary, pair binary, pair_n binary")
    built = counted.groupBy("region").applyInArrow(
        _build(filter_bits // regions), "region int, bits binary, word binary, word_n binary, n long, v long")
    return stored(built, "ngrams")


def _ask(regions: int, chunk: int):
    """For each chunk a row with its tokens (in a region of its own, below 0), and its questions for each region."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for nth, (ids, some) in enumerate(_chunks(batches, chunk)):
            code, starts = tokens(some)
            words, inverse = np.unique(code, return_inverse=True)
            pairs, name = np.unique(_pairs(code)), (part << 32) + nth
            rows = [{"region": -1 - name, "chunk": name, "words": pack_sorted(words), "doc_ids": ids,
                     "held_out": [held_out(i) for i in ids], "sizes": np.diff(starts).tolist(),
                     "tokens": pack(inverse.astype(np.uint32))}]
            cuts = _by_region(words, regions), _by_region(pairs, regions)
            for r in range(regions):
                (a, b), (c, d) = (cut[r:r + 2] for cut in cuts)
                if a < b or c < d:
                    rows.append({"region": r, "chunk": name, "words": pack_sorted(words[a:b]), "pairs": pack_sorted(pairs[c:d])})
            yield pa.RecordBatch.from_pylist(rows, _ASKED)

    return run


_WHOLE = [("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
          ("tokens", pa.binary())]
_ASKED = pa.schema([("region", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), *_WHOLE])
_ANSWER = pa.schema([("region", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()),
                     ("levels", pa.binary()), *_WHOLE])
_WHOLE_DDL = "doc_ids array<long>, held_out array<boolean>, sizes array<long>, tokens binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("log_counts", pa.float64()), ("score", pa.float64())])


def _levels(known: CountFilter | None, asked: list[bytes]):
    """The levels of each set of pairs, probed about _BLOCK at a time."""
    some, n = [], 0
    for i, pairs in enumerate(asked):
        some.append(unpack_sorted(pairs))
        n += len(some[-1])
        if n >= _BLOCK or i + 1 == len(asked):
            keys = np.concatenate(some)
            found = known.level(keys) if known else np.zeros(len(keys), np.int64)
            yield from np.split(found.astype(np.uint8), np.cumsum([len(x) for x in some])[:-1])
            some, n = [], 0


def _answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
    if asked.num_rows and asked.column("region")[0].as_py() < 0:
        return pa.Table.from_pylist(asked.to_pylist(), _ANSWER)
    words, n, known = np.empty(0, np.uint64), np.empty(0, np.int64), None
    if counted.num_rows:
        bits, words, n = (counted.column(c)[0].as_py() for c in ("bits", "word", "word_n"))
        known, words, n = CountFilter(unpack(bits, np.uint8), 1), unpack_sorted(words), unpack(n, np.int64)
    rows, columns = [], [asked.column(c).to_pylist() for c in ("region", "chunk", "words", "pairs")]
    for region, chunk, keys, level in zip(*columns[:3], _levels(known, columns[3])):
        keys = unpack_sorted(keys)
        at = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
        counts = np.where(words[at] == keys, n[at], 0) if len(words) else np.zeros(len(keys), np.int64)
        rows.append({"region": region, "chunk": chunk, "counts": pack(counts), "levels": pack(level)})
    return pa.Table.from_pylist(rows, _ANSWER)


def _finish(total: int, distinct: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("region").to_numpy())
        whole = group.slice(int(order[0]), 1)
        counts, found = (np.concatenate([unpack(blobs[i], kind) for i in order[1:]]) for blobs, kind in (
            (group.column("counts").to_pylist(), np.int64), (group.column("levels").to_pylist(), np.uint8)))
        inverse = unpack(whole.column("tokens")[0].as_py(), np.uint32)
        own = counts[inverse]
        pair = np.unique(_pairs(unpack_sorted(whole.column("words")[0].as_py())[inverse]), return_inverse=True)[1]
        context = np.concatenate((own[-1:], own[:-1]))
        both = np.minimum(ESTIMATES[found][pair], context)
        score = np.log10((both + PRIOR * (own + 1) / (total + distinct + 1)) / (context + PRIOR))
        sizes = np.array(whole.column("sizes")[0].as_py())
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return pa.Table.from_arrays([
            pa.array(whole.column("doc_ids")[0].as_py(), pa.int64()), pa.array(whole.column("held_out")[0].as_py()),
            pa.array(sizes), pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(np.log10(own + 1.0), starts)), pa.array(np.add.reduceat(score, starts))], schema=_OUT)

    return run


def score_texts(docs: DataFrame, filter_bits: int = FILTER_BITS, chunk: int = CHUNK) -> DataFrame:
    """Scores for every row of `docs` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) mod 7 is not 2 are learned from; an id that is null counts as the empty text there. Null and
    empty texts have the end token only. Repeated rows are learned from and scored each. An empty table gives no rows,
    and other columns are ignored. `score` sums log10 of (c(vw) + PRIOR * p(w)) / (c(v) + PRIOR) with
    p(w) = (c(w) + 1) / (N + V + 1); c(vw) is read from the filter and at most c(v), all else is exact. `filter_bits` is what
    the filter has at least: regions with more pairs get more."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    regions = max(power_of_two(2 * spread(docs)), 16)
    built = count_ngrams(rows, regions, filter_bits, chunk)
    total, distinct = (x or 0 for x in built.agg(F.sum("n"), F.sum("v")).first())
    asked = rows.mapInArrow(_ask(regions, chunk), f"region long, chunk long, words binary, pairs binary, {_WHOLE_DDL}")
    known = built.select(F.col("region").cast("long").alias("region"), "bits", "word", "word_n")
    answers = asked.groupBy("region").cogroup(known.groupBy("region")).applyInArrow(
        lambda a, b: _answer(a, b), f"region long, chunk long, words binary, counts binary, levels binary, {_WHOLE_DDL}")
    out = answers.groupBy("chunk").applyInArrow(
        _finish(total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score")
