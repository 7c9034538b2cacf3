"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 consecutive words; a shorter item is one window) are sets of word shingles. A
document contains a window only if it contains all of its shingles, so for containment 1 the necessary prefix
is one shingle: the rarest in the corpus. Rarity is counted over all documents. Documents are then joined with
the windows on prefix shingles; the occurrence's position must leave room for the whole window in the document
(length and positional bounds), and the window's words are compared exactly.

The benchmark is the stated query set: it goes to the workers in blocks of at most BLOCK_WORDS words, one pass over
the documents for each block."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, share, shared, stored, texts

WINDOW, SHINGLE, BLOCK_WORDS = 13, 3, 200_000
#: Every ASCII character that is neither digit nor small letter parts words, once A-Z are lower-cased.
_GAPS = bytes.maketrans(
    bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122)),
    b" " * (128 - 36))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_GAPS).split() if text else []


class Windows:
    """A block of benchmark windows: word numbers, shingle codes and, once rarities are known, the prefix index.

    Words are numbered from 1; 0 is any other word, so a shingle with a 0 is in no window. A shingle of
    fewer than SHINGLE words (from shorter windows) is padded with the number above all words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.items: list[list] = []
        at: dict[tuple[int, ...], int] = {}
        for item_id, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                row = tuple(own[i:i + window])
                if row not in at:
                    at[row] = len(self.rows)
                    self.rows.append(row)
                    self.items.append([])
                if item_id is not None and (not self.items[at[row]] or self.items[at[row]][-1] != item_id):
                    self.items[at[row]].append(item_id)
        self.base = len(self.number) + 2
        pairs = [self.codes_of(r) for r in self.rows]
        self.codes = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.short = sorted({len(r) for r in self.rows if len(r) < SHINGLE})

    def codes_of(self, row: tuple[int, ...]) -> np.ndarray:
        padded = row + (self.base - 1,) * (SHINGLE - len(row))
        a = np.array(padded, np.int64)
        return (a[:-2] * self.base + a[1:-1]) * self.base + a[2:]

    def occurrences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of known shingles in `codes` and the positions at which they begin."""
        places, found = [], []
        for n in [*self.short, SHINGLE]:
            ends = len(numbers) - n + 1
            if ends <= 0:
                continue
            known = numbers[:ends] > 0
            for i in range(1, n):
                known &= numbers[i:ends + i] > 0
            pos = np.flatnonzero(known)
            code = numbers[pos]
            for i in range(1, SHINGLE):
                code = code * self.base + (numbers[pos + i] if i < n else self.base - 1)
            if len(self.codes) and len(code):
                i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[i] == code
                places.append(i[hit])
                found.append(pos[hit])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places), np.concatenate(found)

    def index(self, rarity: np.ndarray) -> None:
        """For each window its rarest shingle (the first of equally rare ones), grouped by shingle."""
        prefix, offset = [], []
        for row in self.rows:
            at = np.searchsorted(self.codes, self.codes_of(row))
            k = int(np.argmin(rarity[at]))
            prefix.append(at[k])
            offset.append(k)
        self.offset = np.array(offset, np.int64)
        self.order = np.argsort(np.array(prefix, np.int64), kind="stable")
        self.begin = np.searchsorted(np.array(prefix, np.int64)[self.order], np.arange(len(self.codes) + 1))
        width = max(map(len, self.rows), default=0)
        self.matrix = np.array([r + (0,) * (width - len(r)) for r in self.rows], np.int64).reshape(len(self.rows), width)

    def matches(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence of a window inside a document; documents begin at `starts`."""
        shingle, pos = self.occurrences(numbers)
        many = self.begin[shingle + 1] - self.begin[shingle]
        row = np.repeat(np.arange(len(shingle)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        window = self.order[self.begin[shingle][row] + nth]
        at = pos[row] - self.offset[window]
        doc = np.searchsorted(starts, pos[row], "right") - 1
        fits = (at >= starts[doc]) & (at + self.lengths[window] <= starts[doc + 1] - 1)
        at, window = at[fits], window[fits]
        same = np.ones(len(at), bool)
        for i in range(self.matrix.shape[1]):
            on = np.flatnonzero(same & (i < self.lengths[window]))
            same[on] = numbers[at[on] + i] == self.matrix[window[on], i]
        return at[same], window[same]


def _numbered(batch: pa.RecordBatch, text_col: str, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts of a batch with a 0 behind each text, and where each text begins."""
    out, starts, get = [], [0], number.get
    for text in texts(batch, text_col):
        own = words(text)
        ids = np.zeros(len(own) + 1, np.int64)
        ids[:-1] = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        out.append(ids)
        starts.append(starts[-1] + len(ids))
    return np.concatenate(out) if out else np.empty(0, np.int64), np.array(starts, np.int64)


def _count_shingles(block, text_col: str):
    def count(batches):
        windows = shared(block)
        total = np.zeros(len(windows.codes), np.int64)
        for batch in batches:
            numbers, _ = _numbered(batch, text_col, windows.number)
            total += np.bincount(windows.occurrences(numbers)[0], minlength=len(total))
        on = np.flatnonzero(total)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["shingle", "n"])

    return count


def _join(block, text_col: str, names: dict[str, str]):
    """Adds to each row what the block's windows hit: runs of hit words (start, length) and item ids."""

    def join(batches):
        windows = shared(block)
        for batch in batches:
            numbers, starts = _numbered(batch, text_col, windows.number)
            at, window = windows.matches(numbers, starts)
            doc = np.searchsorted(starts, at, "right") - 1
            order = np.lexsort((at, doc))
            at, window, doc = at[order], window[order], doc[order]
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            n_words, runs, items = [], [], []
            before = batch.column(names["runs"]).to_pylist() if names["runs"] in batch.schema.names else None
            seen = batch.column(names["items"]).to_pylist() if before is not None else None
            for i in range(batch.num_rows):
                lo, hi = edge[i], edge[i + 1]
                own, ids = [], set()
                if hi > lo:
                    own = list(zip((at[lo:hi] - starts[i]).tolist(), windows.lengths[window[lo:hi]].tolist()))
                    ids = {str(x) for w in np.unique(window[lo:hi]) for x in windows.items[w]}
                if before is not None:
                    own, ids = sorted(own + [(r["at"], r["n"]) for r in before[i]]), ids | set(seen[i])
                merged: list[list[int]] = []
                for s, n in own:
                    if merged and s <= merged[-1][0] + merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s + n - merged[-1][0])
                    else:
                        merged.append([s, n])
                runs.append([{"at": s, "n": n} for s, n in merged])
                items.append(sorted(ids))
                n_words.append(int(starts[i + 1] - starts[i] - 1))
            run = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            added = {names["n_words"]: pa.array(n_words, pa.int64()), names["runs"]: pa.array(runs, run),
                     names["items"]: pa.array(items, pa.list_(pa.string()))}
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in added]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()),
                                             names=[n for n, _ in kept] + list(added))

    return join


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with three more columns, and their names (changed only where `docs` has them already): `n_words`, `runs`
    (maximal runs of hit words: at, n) and `items` (ids of items with an occurring window, as sorted strings).

    Null or wordless texts have no words and no runs; null or wordless items have no windows; windows of an item whose
    id is null mark words but name no item; repeated rows of either table change nothing else. Both tables may
    be empty."""
    names = {n: fresh(docs, n) for n in ("n_words", "runs", "items")}
    spark = docs.sparkSession
    item = F.col(item_text_col).cast("binary")
    asked = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), item.alias("text")).distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (4 * block_words)))
    out = docs
    schema = f"{{}}, `{names['n_words']}` long, `{names['runs']}` array<struct<at:long,n:long>>, `{names['items']}` array<string>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()
        windows = Windows(sorted(((r["item"], bytes(r["text"])) for r in rows), key=lambda x: (str(x[0]), x[1])), window)
        rarity = np.zeros(len(windows.codes), np.int64)
        block = share(spark, windows)
        counted = docs.select(text_col).mapInArrow(_count_shingles(block, text_col), "shingle long, n long")
        for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect():
            rarity[r["shingle"]] = r["n"]
        windows.index(rarity)
        block = share(spark, windows)
        out = out.mapInArrow(_join(block, text_col, names), schema.format(fields))
        if k + 1 < n_blocks:
            out = stored(out, "contamination")
    return out, names


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    found, names = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate(names["runs"], F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
    ids = F.col(names["items"])
    return found.select("doc_id", F.col(names["n_words"]).alias("n_words"), n_hit.alias("n_hit"), ids.alias("ids")).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated (hit words under a twentieth of all), columns unchanged."""
    found, names = find_contamination(docs, benchmark, text_col)
    n_hit = F.aggregate(names["runs"], F.lit(0).cast("long"), lambda acc, r: acc + r["n"])
    hit = (n_hit > 0) & (20 * n_hit >= F.col(names["n_words"]))
    return found.where(~hit).select(*docs.columns)
