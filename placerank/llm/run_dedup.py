"""Removal of long repeated byte strings with run-length compressed indexes.

Two equal strings of WINDOW bytes have the same smallest GRAM-byte substring (by hash) at the same place, so strings are
dealt out by a key that they share and equal ones meet. The key is the hash of the anchor with the bytes that all strings of
about half of its places have besides: those behind it for places near its string's start, those before it for the others.

1. Documents are packed into chunks of about CHUNK bytes (or one document), stored in the shared folder.
2. Each chunk sends its distinct keys and how often it has them by range of hash, and learns which occur more than once in
   the corpus, and which are hot: so frequent that their pieces could fill more than one index.
3. For keys that occur more than once a chunk cuts pieces (the strings that a key stands for, in a row) and sends each
   distinct one once, again by range of hash. Strings of a hot key are single pieces, each dealt by its own hash.
4. For each range the distinct pieces, in the order of their first places, form a run-compressed Burrows-Wheeler index. All
   pieces are streamed through it; matching statistics tell for each string the first place of those equal to it.
5. The answers go back to the chunks, where every string that also starts earlier is marked and removed.

What a range receives from a chunk is distinct, so a passage that fills a third of the corpus is a string for each
chunk and place in it. A line whose neighbours differ each time gives other strings each time, which go to different
ranges. Chunks are bounded in bytes, the number of ranges follows that of partitions, and a range builds one index after
another; one key adds at most about HOT times `index_bytes` to an index, or a string for each chunk if it is hot."""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import power_of_two, spread, stored, texts
from .packing import pack, pack_sorted, unpack, unpack_sorted
from .run_index import RunIndex

#: Indexes of this many bytes stay in a core's cache; a key is hot if its strings, of two windows each, could fill HOT of them.
WINDOW, GRAM, CHUNK, INDEX, HOT = 100, 40, 4 << 20, 1 << 18, 4
_BASE, _BLOCK, _LAST = 0x9E3779B97F4A7C15, 1 << 19, (1 << 63) - 1
_CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, data binary"
_ASKED = pa.schema([("region", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_KNOWN = pa.schema([("chunk", pa.int64()), ("region", pa.int64()), ("flags", pa.binary())])
_PIECES = pa.schema([("region", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("sizes", pa.binary()),
                     ("docs", pa.binary()), ("places", pa.binary()), ("starts", pa.binary()), ("keys", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int64()), ("region", pa.int64()), ("marks", pa.binary()), ("sizes", pa.binary()),
                    ("places", pa.binary()), ("starts", pa.binary())])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPAN),
                  ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_chunks(size: int):
    def row(part, nth, docs):
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        data = b"".join(t for _, t in docs)
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + nth]), pa.array([[i for i, _ in docs]], pa.list_(pa.int64())),
            pa.array([[len(t) for _, t in docs]], pa.list_(pa.int64())), pa.array([_squeeze(data)], pa.binary())],
            names=["chunk", "doc_ids", "sizes", "data"])

    def run(batches):
        part, nth, docs, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                docs.append((doc_id, text or b""))
                n += len(text or b"") + 64
                if n >= size:
                    yield row(part, nth, docs)
                    nth, docs, n = nth + 1, [], 0
        if docs:
            yield row(part, nth, docs)

    return run


def _grams(flat: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    rng = np.random.default_rng(5)
    power = {1: rng.integers(1 << 63, size=256, dtype=np.uint64)[flat]}
    width = 1
    while width * 2 <= k:
        h = power[width]
        power[width * 2] = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    out, done = power[width], width
    while done < k:
        width = max(w for w in power if w <= k - done)
        n = len(flat) - done - width + 1
        out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width][done:done + n]
        done += width
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(flat: np.ndarray, sizes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start) for each run of strings with one anchor and key. Of equal hashes in a string the
    leftmost is its anchor. No string crosses the end of a document."""
    ends, found = np.cumsum(sizes), []
    half = (window - k) // 2
    behind, before = window - half - k, half + 1
    for lo in range(0, len(flat) - window + 1, _BLOCK):
        part = flat[lo:lo + _BLOCK + window - 1]
        h = _grams(part, k)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wide, span = 1, window - k + 1
        while wide * 2 <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < span:
            low = np.minimum(low[:wide - span], low[span - wide:])
        start = np.arange(lo, lo + len(low))
        doc_end = np.repeat(ends, sizes)[start] if len(ends) < len(flat) else ends[np.searchsorted(ends, start, "right")]
        start = start[start + window <= doc_end]
        at = (low[start - lo] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if len(start):
            head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
            last = np.append(head[1:] - 1, len(start) - 1)
            anchor, first, last = at[head], start[head], start[last]
            # Strings up to `half` before their anchor have the bytes behind it in common, those further left the ones before.
            turn = anchor + lo - half
            near, far = np.flatnonzero(last >= turn), np.flatnonzero(first < turn)
            key = np.concatenate((h[anchor[near]] * np.uint64(_BASE) + h[anchor[near] + behind],
                                  h[anchor[far] - before] * np.uint64(_BASE) ^ h[anchor[far]]))
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            first, last = (np.concatenate(x) for x in ((np.maximum(first, turn)[near], first[far]),
                                                       (last[near], np.minimum(last, turn - 1)[far])))
            order = np.argsort(first)
            found.append(((key ^ (key >> np.uint64(32)))[order], first[order], last[order]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _edges(keys: np.ndarray, regions: int) -> list[int]:
    step = (1 << 64) // regions
    return np.searchsorted(keys, np.array([i * step for i in range(regions)], np.uint64)).tolist() + [len(keys)]


def _ask(regions: int, window: int, k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                flat = np.frombuffer(_expand(r["data"]), np.uint8)
                keys, n = np.unique(anchors(flat, np.array(r["sizes"], np.int64), window, k)[0], return_counts=True)
                cut, n = _edges(keys, regions), n.astype(np.uint32)
                rows = [{"region": i, "chunk": r["chunk"], "hashes": pack_sorted(keys[cut[i]:cut[i + 1]]),
                         "counts": pack(n[cut[i]:cut[i + 1]])}
                        for i in range(regions) if cut[i] < cut[i + 1]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ASKED)

    return run


def _tell(hot: int):
    def run(group: pa.Table) -> pa.Table:
        """For each chunk and key of it 0 if the corpus has it once, 2 if more than `hot` times, else 1."""
        asked = [unpack_sorted(x) for x in group.column("hashes").to_pylist()]
        counts = [unpack(x, np.uint32) for x in group.column("counts").to_pylist()]
        keys = np.sort(np.concatenate(asked))
        shared = np.unique(np.concatenate([keys[1:][keys[1:] == keys[:-1]], *(x[n > 1] for x, n in zip(asked, counts))]))
        del keys
        total, rows = np.zeros(len(shared) + 1, np.int64), []

        def found(own: np.ndarray) -> np.ndarray:
            at = np.searchsorted(shared, own)
            return np.where(np.append(shared, 0)[at] == own, at, len(shared)) if len(shared) else np.zeros(len(own), np.int64)

        for own, n in zip(asked, counts):
            total[found(own)] += n
        level = np.append(1 + (total[:-1] > hot), 0).astype(np.uint8)
        for chunk, own in zip(group.column("chunk").to_pylist(), asked):
            rows.append({"chunk": chunk, "region": group.column("region")[0].as_py(),
                         "flags": _squeeze(level[found(own)].tobytes())})
        return pa.Table.from_pylist(rows, _KNOWN)

    return run


def _cut(regions: int, window: int, k: int):
    from xxhash import xxh3_64_intdigest

    def run(chunks: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        for r in chunks.to_pylist():
            data, sizes = _expand(r["data"]), np.array(r["sizes"], np.int64)
            hashes, first, last = anchors(np.frombuffer(data, np.uint8), sizes, window, k)
            keys, inverse = np.unique(hashes, return_inverse=True)
            cut, level = _edges(keys, regions), np.zeros(len(keys), np.uint8)
            for region, flags in zip(known.column("region").to_pylist(), known.column("flags").to_pylist()):
                level[cut[region]:cut[region + 1]] = np.frombuffer(_expand(flags), np.uint8)
            on = np.flatnonzero(level[inverse] > 0)
            hashes, first, last, level = hashes[on], first[on], last[on], level[inverse][on]
            if (level > 1).any():
                many = np.where(level > 1, last - first + 1, 1)
                hot = np.repeat(level > 1, many)
                start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                hashes, last = np.repeat(hashes, many), np.where(hot, start, np.repeat(last, many))
                hashes[hot] = [xxh3_64_intdigest(data[i:i + window]) for i in start[hot].tolist()]
                first = start
            index: dict[bytes, int] = {}
            own = np.fromiter((index.setdefault(data[a:b + window], len(index))
                               for a, b in zip(first.tolist(), last.tolist())), np.int64, len(first))
            pieces, head = list(index), np.unique(own, return_index=True)[1]
            # Pieces are numbered by region, and within one by their first place in the chunk.
            order = np.argsort(hashes[head] // np.uint64((1 << 64) // regions), kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            rows.append({"region": -1 - r["chunk"], "chunk": r["chunk"], "sizes": pack(last - first + 1),
                         "places": pack(number[own]), "starts": pack(first)})
            begin = np.concatenate(([0], np.cumsum(sizes)))
            place = np.searchsorted(begin, first[head][order], "right") - 1
            doc = np.array([_LAST if i is None else i for i in r["doc_ids"]], np.int64)
            start = first[head][order] - begin[place]
            region = (hashes[head][order] // np.uint64((1 << 64) // regions)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True]))) if len(region) else []
            for lo, hi in zip(edge, edge[1:]):
                some = [pieces[i] for i in order[lo:hi]]
                rows.append({"region": int(region[lo]), "chunk": r["chunk"], "data": _squeeze(b"".join(some)),
                             "sizes": pack(np.fromiter(map(len, some), np.int64, len(some))), "docs": pack(doc[place[lo:hi]]),
                             "places": pack(place[lo:hi]), "starts": pack(start[lo:hi]),
                             "keys": pack((hashes[head][order][lo:hi] >> np.uint64(8)).astype(np.uint16))})
        return pa.Table.from_pylist(rows, _PIECES)

    return run


def _marks(pieces: list[bytes], order: np.ndarray, window: int) -> np.ndarray:
    """For each piece a bit for each of its strings that also starts earlier. `order` lists the pieces by place."""
    index: dict[bytes, int] = {}
    number = np.empty(len(pieces), np.int64)
    for i in order.tolist():
        number[i] = index.setdefault(pieces[i], len(index))
    distinct = list(index)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    runs = RunIndex(distinct, window)
    marks = np.zeros(len(distinct), np.uint64)
    for done, live, earliest in runs.matching_statistics(distinct):
        at = size[live] - done
        again = earliest != runs.starts[live] + at
        marks[live[again]] |= np.uint64(1) << at[again].astype(np.uint64)
    # Where a piece is not the first of its kind, all of its strings have been before.
    out = np.full(len(pieces), (1 << 64) - 1, np.uint64)
    first = order[np.concatenate(([True], np.maximum.accumulate(number[order])[:-1] < number[order][1:]))]
    out[first] = marks[number[first]]
    return out


def _mark(window: int, index_bytes: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["region"] < 0:
            return pa.Table.from_pylist([r | {"marks": None} for r in rows], _MARKS)
        pieces, places, keys = [], [], []
        for r in rows:
            data, sizes = _expand(r["data"]), unpack(r["sizes"], np.int64)
            pieces += [data[b - n:b] for n, b in zip(sizes.tolist(), np.cumsum(sizes).tolist())]
            places.append(np.stack([unpack(r["docs"], np.int64), np.full(len(sizes), r["chunk"]),
                                    unpack(r["places"], np.int64), unpack(r["starts"], np.int64)]))
            keys.append(unpack(r["keys"], np.uint16))
        edge = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        doc, chunk, place, start = np.concatenate(places, axis=1)
        # One index for about `index_bytes` of pieces: those of a key stay together.
        n = -(-sum(map(len, pieces)) // index_bytes)
        own = np.concatenate(keys).astype(np.int64) * n >> 16
        marks = np.empty(len(pieces), np.uint64)
        for k in np.unique(own):
            on = np.flatnonzero(own == k)
            order = np.lexsort((start[on], place[on], chunk[on], doc[on]))
            marks[on] = _marks([pieces[i] for i in on], order, window)
        return pa.Table.from_pylist([
            {"chunk": r["chunk"], "region": r["region"], "marks": pack(marks[edge[i]:edge[i + 1]])}
            for i, r in enumerate(rows)], _MARKS)

    return run


def _remove(window: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in chunks.to_pylist():
            flat, sizes = np.frombuffer(_expand(r["data"]), np.uint8), np.array(r["sizes"], np.int64)
            edges = np.zeros(len(flat) + 1, np.int64)
            told = sorted(answers.to_pylist(), key=lambda a: a["region"])
            if len(told) > 1:
                marks = np.concatenate([unpack(a["marks"], np.uint64) for a in told[1:]])
                own, many, start = (unpack(told[0][c], np.int64) for c in ("places", "sizes", "starts"))
                again = np.ones(len(own), bool)
                again[np.unique(own, return_index=True)[1]] = False
                bits = np.where(again, np.uint64((1 << 64) - 1), marks[own])
                on = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, j = np.nonzero(on)
                inside = j < many[i]
                at = start[i[inside]] + j[inside]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
            gone = np.cumsum(edges[:-1]) > 0
            begin = np.concatenate(([0], np.cumsum(sizes)))
            for doc_id, lo, hi in zip(r["doc_ids"], begin.tolist(), begin[1:].tolist()):
                cut = gone[lo:hi]
                turn = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)) if cut.any() else np.empty(0, int)
                out.append({"doc_id": doc_id, "n_bytes": hi - lo, "n_removed": int(cut.sum()),
                            "spans": [{"start": a, "length": b - a} for a, b in turn.reshape(-1, 2).tolist()],
                            "kept": flat[lo:hi][~cut].tobytes()})
        return pa.Table.from_pylist(out, _OUT)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK,
                   index_bytes: int = INDEX) -> DataFrame:
    """For every row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, spans (start, length of removed runs) and kept.

    Every byte inside a string of `window` bytes that also starts earlier is removed: in a document with a smaller id, or in the
    same one further left. Strings overlap, never cross documents, and are judged on the whole input. A null text is
    empty. Rows with equal ids come in the order of their place in the input, null ids last. Empty tables give no rows;
    other columns are ignored. `window` is at most `gram` + 63."""
    if not gram <= window <= gram + 63:
        raise ValueError("window must lie between gram and gram + 63")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(rows.mapInArrow(_pack_chunks(chunk), _CHUNKS), "chunks")
    regions = power_of_two(max(8, spread(docs)))
    asked = chunks.select("chunk", "sizes", "data").mapInArrow(_ask(regions, window, gram), _ddl(_ASKED))
    known = asked.groupBy("region").applyInArrow(_tell(HOT * index_bytes // (2 * window)), _ddl(_KNOWN))
    pieces = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _cut(regions, window, gram), _ddl(_PIECES))
    marks = pieces.groupBy("region").applyInArrow(_mark(window, index_bytes), _ddl(_MARKS))
    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(
        _remove(window), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
