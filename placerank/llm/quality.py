"""Quality rules: statistics of each text, fixed limits, and an isolation forest whose cut-off labelled rows set.

The forest is grown on a bounded sample of labelled rows (SAMPLE of them, those with the smallest hash of their id): each
tree takes SUBSAMPLE of the good ones and splits a box, at first the ranges of all sampled rows, at random places along random
features until a box holds one row or the depth is used up. A document that falls into a region without good rows is on
its own after few splits: its path is short, its score high. The cut-off is chosen over all labelled rows, from counts of
scores by bin and label. Scoring covers every document."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, share, shared, stored, texts

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
TREES, SUBSAMPLE, SAMPLE, DEPTH, BINS, FALSE_REJECT_COST = 100, 256, 25_600, 12, 1000, 10.0
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_upper",
              "n_lower"]
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MIX = [pow(0x9E3779B97F4A7C15, n, 1 << 64) for n in (1, 2, 4)]


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(batch: list[bytes | None], window: int = WINDOW) -> np.ndarray:
    """One row for each text, in the order of STATISTICS. Null and empty texts have zeros throughout.

    Repeated windows are found for a whole batch at once: equal hashes of `window` words (a power of two) in one text."""
    out = np.zeros((len(batch), len(STATISTICS)), np.int64)
    hashes, owner = [], []
    for i, text in enumerate(batch):
        if not text:
            continue
        words = text.split()
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else int(np.count_nonzero(
            np.frombuffer(joined, np.uint8) & 0xC0 != 0x80))
        upper = len(joined) - len(joined.translate(None, _UPPER))
        lower = len(joined) - len(joined.translate(None, _UPPER.lower()))
        lines, repeated = _line_counts(text)
        out[i] = (len(words), chars, sum(map(joined.count, SYMBOLS)), repeated, 0, lines, joined.count(b"!"), upper, lower)
        if len(words) > window:
            hashes.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
            owner.append(i)
    if not hashes:
        return out
    starts = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    code = np.concatenate(hashes)
    step = 1
    for m in _MIX:
        if step < window:
            code = code[:-step] * np.uint64(m) + code[step:]
            step *= 2
    doc = np.repeat(np.arange(len(hashes)), np.diff(starts))
    whole = np.flatnonzero(doc[:len(code)] == doc[window - 1:])
    key = code[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    at = whole[order[twin]]
    edges = np.bincount(at, minlength=starts[-1] + 1) - np.bincount(at + window, minlength=starts[-1] + 1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    out[owner, STATISTICS.index("n_repeat_words")] = inside[starts[1:]] - inside[starts[:-1]]
    return out


def features(s: np.ndarray) -> np.ndarray:
    """What the forest sees: ratios of the statistics."""
    n, chars, symbols, dup, repeat, lines, exclaims, upper, lower = s.T.astype(float)
    words = np.maximum(n, 1)
    return np.column_stack([chars / words, symbols / words, dup / np.maximum(lines, 1), repeat / words,
                            exclaims / words, upper / np.maximum(upper + lower, 1)])


def _expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees in arrays: node k has children 2k+1 and 2k+2; feature -1 marks a leaf with its path length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def grow(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE,
             depth: int = DEPTH, seed: int = 7) -> "Forest":
        rng = np.random.default_rng(seed)
        shape = (trees, (2 << depth) - 1)
        feature, cut, path = np.full(shape, -1, np.int8), np.zeros(shape), np.zeros(shape)
        size = min(subsample, len(x))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), size, replace=False)], low.copy(), high.copy())]
            while todo:
                node, d, rows, lo, hi = todo.pop()
                wide = np.flatnonzero(hi > lo)
                if d == depth or len(rows) <= 1 or not len(wide):
                    path[t, node] = d + _expected_path(np.array(len(rows)))
                    continue
                f = int(rng.choice(wide))
                c = rng.uniform(lo[f], hi[f])
                feature[t, node], cut[t, node] = f, c
                left = rows[:, f] < c
                hi_left, lo_right = hi.copy(), lo.copy()
                hi_left[f] = lo_right[f] = c
                todo += [(2 * node + 1, d + 1, rows[left], lo, hi_left), (2 * node + 2, d + 1, rows[~left], lo_right, hi)]
        return cls(feature, cut, path, float(max(_expected_path(np.array(max(size, 2))), 1.0)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        for f, c, p in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                on = f[node[live]]
                live, on = live[on >= 0], on[on >= 0]
                node[live] = 2 * node[live] + 1 + (x[live, on] >= c[node[live]])
            total += p[node]
        return np.exp2(-total / (len(self.feature) * self.norm))


def _measure(text_col: str, keep: list[str], names: list[str]):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                s = statistics(texts(some, text_col))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in keep] + [pa.array(c) for c in s.T.copy()],
                                                 names=[*keep, *names])

    return run


def with_statistics(docs: DataFrame, names: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row and its statistics under `names`."""
    fields = [f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    return rows.mapInArrow(_measure(text_col, keep, names), ", ".join(fields + [f"`{n}` long" for n in names]))


def _scored(forest, names: list[str], score: str):
    def run(batches):
        grown = shared(forest)
        for batch in batches:
            s = np.column_stack([batch.column(n).to_numpy() for n in names])
            column = pa.array(grown.score(features(s)) if grown else np.zeros(len(s)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, score])

    return run


def with_scores(measured: DataFrame, forest, names: list[str], score: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema)
    return measured.mapInArrow(_scored(forest, names, score), f"{fields}, `{score}` double")


def _first_by_hash(labelled: DataFrame, id_col: str, sample: int) -> list:
    """The `sample` rows with the smallest hashes. A bound on the hash, from the number of rows, keeps what tasks send to the driver
    near that number; should it let too few through, all rows are taken in."""
    h, n = F.xxhash64(id_col, F.lit(11)), labelled.count()
    bound = min(1.0, 1.2 * sample / max(n, 1) + 1e-3)
    for part in ([bound] if bound < 1 else []) + [1.0]:
        few = labelled if part == 1.0 else labelled.where(h < F.lit(int(part * 2.0**64 - 2.0**63)))
        rows = few.orderBy(h, id_col, *STATISTICS).limit(sample).select(*STATISTICS, "quality").collect()
        if len(rows) == min(n, sample):
            return rows
    return rows


@dataclass
class Verdict:
    """A fitted forest (broadcast; its size depends on TREES and DEPTH only) and the least score that is rejected."""

    forest: object
    cut_off: float


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE,
        false_reject_cost: float = FALSE_REJECT_COST) -> Verdict:
    """Grow the forest on at most `sample` labelled rows and set its cut-off over all labelled rows.

    `measured` has the id and STATISTICS. `labels` has the id and quality (1 good, 0 bad; other rows are ignored). The
    cut-off maximises the share of bad rows rejected less `false_reject_cost` times the share of good rows rejected, the
    highest such cut-off if several do. Without labelled good rows nothing is rejected."""
    spark = measured.sparkSession
    labelled = measured.join(labels.where(F.col("quality").isin(0, 1)).select(id_col, "quality"), id_col)
    labelled = stored(labelled.select(id_col, *STATISTICS, "quality"), "labelled")
    rows = _first_by_hash(labelled, id_col, sample)
    x = features(np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(STATISTICS)))
    good = np.array([r["quality"] == 1 for r in rows], bool)
    if not good.any():
        return Verdict(share(spark, None), 2.0)
    forest = share(spark, Forest.grow(x[good], x.min(axis=0), x.max(axis=0)))
    scored = with_scores(labelled, forest, STATISTICS, "score")
    counts = scored.groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").count().collect()
    table = np.zeros((2, BINS + 2))
    for r in counts:
        table[r["quality"], r["bin"]] += r["count"]
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1] / np.maximum(table.sum(axis=1, keepdims=True), 1)
    gain = above[0] - false_reject_cost * above[1]
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return Verdict(forest, best / BINS)


def base_failed(names: dict[str, str]):
    n, repeat = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEATED_PERCENT * n)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, kept and the forest's score for every document."""
    measured = stored(with_statistics(docs.select("doc_id", "text"), STATISTICS, ["doc_id"]), "statistics")
    verdict = fit(measured, labels)
    failed = base_failed({n: n for n in STATISTICS})
    return with_scores(measured, verdict.forest, STATISTICS, "score").select(
        "doc_id", *STATISTICS[:5], failed.alias("base_failed"),
        (~failed & (F.col("score") < verdict.cut_off)).alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass the fixed limits and the forest, columns unchanged.

    Null, empty and wordless texts fail the limits. Repeated rows are judged alike. An id with several labels counts once
    for each. Rows without an id are judged too; they only cannot be labelled."""
    # All texts are measured for the fit too: joining the labels first would send the texts through a shuffle.
    verdict = fit(with_statistics(docs.select("doc_id", "text"), STATISTICS, ["doc_id"]), labels)
    names = {n: fresh(docs, n) for n in [*STATISTICS, "score"]}
    own = [names[n] for n in STATISTICS]
    # Measured and scored by one worker in one pass.
    measure, score = _measure("text", docs.columns, own), _scored(verdict.forest, own, names["score"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` long" for n in own] + [f"`{names['score']}` double"]
    rows = docs.mapInArrow(lambda batches: score(measure(batches)), ", ".join(fields))
    return rows.where(~base_failed(names) & (F.col(names["score"]) < verdict.cut_off)).select(*docs.columns)
