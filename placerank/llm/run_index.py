"""A run-length compressed Burrows-Wheeler index over many short texts, and matching statistics read from it."""

import numpy as np

#: Symbols of nine bits that one number holds.
_END, FIRST = 0, 7


def suffix_order(text: np.ndarray, longest: int, window: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Suffix array of ended texts written one after the other; the greatest number of symbols up to `window` by which suffixes
    were ranked on the way, more than half of it, and those ranks.

    `text` holds symbols from 1 to 256 and ends each text with 0; no text is longer than `longest` with its end. Suffixes
    are ranked by FIRST symbols at once, then ranks are doubled; suffixes that are equal up to their end keep the order of the texts. Ranks and positions share one
    64-bit key where they fit, so that a plain sort does."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    position = np.arange(n, dtype=np.uint64)
    # A suffix that reaches its end is only compared up to there: beyond it ranks count as 0.
    left = np.flatnonzero(text == _END)
    rest = left[np.searchsorted(left, np.arange(n))] - np.arange(n)
    first = min(FIRST, window, longest)
    code = text.astype(np.uint64)
    for i in range(1, first):
        following = np.zeros(n, np.uint64)
        following[:-i] = text[i:]
        following[rest < i] = 0
        code = (code << np.uint64(9)) | following
    order = np.argsort(code)
    code = code[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate(([True], code[1:] != code[:-1])))
    depth = first
    kept = depth, rank.astype(np.int64)
    while True:
        more = np.zeros(n, np.uint64)
        reach = np.flatnonzero(rest >= depth)
        more[reach] = rank[reach + depth]
        width = max(bits, 9)
        if 2 * width + bits <= 64:
            key = np.sort((rank << np.uint64(width + bits)) | (more << np.uint64(bits)) | position)
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            key >>= np.uint64(bits)
        else:
            pair = (rank << np.uint64(32)) | more
            order = np.argsort(pair, kind="stable")
            key = pair[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        depth *= 2
        if depth <= window:
            kept = depth, rank.astype(np.int64)
        if depth >= longest:
            return order, *kept


class RunIndex:
    """The transform as runs: their symbols, first rows and ranks, text positions sampled at the ends of runs, and for
    each set of suffixes that agree on `window` symbols its first row and smallest position in the given order."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        flat[self.starts[1:] - 1] = _END
        order, top, ranks = suffix_order(flat, int(sizes.max()), window)
        last = flat[order - 1]
        first = np.concatenate(([True], last[1:] != last[:-1]))
        self.run_row = np.flatnonzero(first)
        self.run_symbol = last[self.run_row]
        length = np.diff(np.append(self.run_row, len(flat)))
        self.run_end_position = order[self.run_row + length - 1]
        # Runs by symbol and row: the number of rows of the symbol before each.
        by = np.argsort(self.run_symbol, kind="stable")
        self.by_symbol = np.searchsorted(self.run_symbol[by], np.arange(258))
        self.rows_of, self.length = self.run_row[by], length[by]
        self.before = np.cumsum(self.length) - self.length
        self.size = len(flat)
        self.by_row = self.run_symbol[by] * self.size + self.rows_of
        # Rows whose suffixes agree on the whole window are neighbours.
        reach = np.repeat(self.starts[1:] - 1, sizes) - np.arange(len(flat)) >= window
        full = np.flatnonzero(reach[order])
        at, shift = order[full], window - top
        same = (np.diff(full) == 1) & (ranks[at[1:]] == ranks[at[:-1]]) & (ranks[at[1:] + shift] == ranks[at[:-1] + shift])
        head = np.concatenate(([True], ~same)) if len(full) else np.empty(0, bool)
        self.class_row = full[head]
        self.class_first = np.minimum.reduceat(at, np.flatnonzero(head)) if len(full) else at

    def step(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Rows before which `symbol` puts the suffixes that begin before `row`: one step of a backward search."""
        first = self.by_symbol[symbol]
        k = np.searchsorted(self.by_row, symbol * self.size + row, "right") - 1
        # Before the first run of the symbol all of its rows are still to come.
        inside = np.where(k >= first, np.minimum(row - self.rows_of[k], self.length[k]), 0)
        return self.before[np.maximum(k, first)] + inside

    def matching_statistics(self, texts: list[bytes]):
        """Stream texts that are in the index, all at once, from their ends to their beginnings; yields for each place
        (number of symbols before the texts' ends) the texts that have a whole window there, with the first position of the
        set of windows equal to theirs.

        A text's search begins with the rows of the end symbol and gains a symbol a step. Its rows, here followed by
        their first, always begin with the rest of the text, so the set they lie in has the matches of a window."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        live = np.flatnonzero(size > 0)
        row = np.zeros(len(texts), np.int64)
        done = 0
        while len(live):
            done += 1
            symbol = flat[begin[live + 1] - done]
            row[live] = self.step(row[live], symbol)
            if done >= self.window:
                c = np.searchsorted(self.class_row, row[live], "right") - 1
                yield done, live, self.class_first[c]
            live = live[size[live] > done]
