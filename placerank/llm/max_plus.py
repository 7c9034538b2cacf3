"""SentencePiece encoding and decoding: the best segmentation by piece scores, as a max-plus scan over chunks.

A text is encoded as a unigram model does: of all ways to write it as pieces, one with the greatest sum of scores. Scores
are whole numbers here (SCALE times the file's, rounded), so sums are exact in any order. A short text is one chunk and solved at once.
A giant one is cut into chunks of CHUNK characters, or a little less so that they end between words. At a cut a piece may reach up to `reach` - 1 characters into the
next chunk; that overhang is the boundary state. Each chunk gives a matrix: for each state at its beginning and each
at its end the greatest score of the pieces that begin inside. Matrices are multiplied (maximum of sums) in groups of
FAN neighbours, level by level, which is sound as the product is associative; then, from the top down, each
group learns its own end states and finds those of its members. With them every chunk is traced back by itself.

Inside a chunk, a space behind another character is a place that no piece crosses (this is checked for the vocabulary), so
words are solved alone: the distinct words of a batch of texts all at once, place by place, with numpy. Nothing is remembered
from batch to batch. Of equally good segmentations the one with the longest last piece counts, and so on backwards; only a
word that is longer than a chunk may get another one of the same score."""

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, share, shared, stored

CHUNK, FAN, SCALE = 1 << 15, 64, 1 << 16
#: Bytes and rows of texts that are solved together, words that are solved at once, and the longest of them.
BATCH, ROWS, WORDS, LONGEST = 1 << 20, 2048, 1 << 13, 64
NEVER = -(1 << 60)
_WORD = re.compile(r" +[^ ]*|[^ ]+")
_SPACE = "▁"


def _fields(data: bytes):
    """(number, value) of each field of a serialised protocol buffer."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i:i + size], i + size
        yield key >> 3, value


class Pieces:
    """The vocabulary of a model file: pieces with their scores, byte pieces, and how far a piece can reach."""

    _NORMAL, _USER, _BYTE = 1, 4, 6

    def __init__(self, model_file: str):
        self.ids: dict[str, int] = {}
        self.byte_ids, self.text, score, kinds = [0] * 256, [], [], []
        with open(model_file, "rb") as f:
            found = [dict(_fields(v)) for n, v in _fields(f.read()) if n == 1]
        for i, piece in enumerate(found):
            name = piece[1].decode()
            kinds.append(piece.get(3, self._NORMAL))
            score.append(round(SCALE * struct.unpack("<f", piece.get(2, bytes(4)))[0]))
            if kinds[-1] == self._BYTE:
                self.byte_ids[int(name[3:5], 16)] = i
                self.text.append(bytes([int(name[3:5], 16)]))
                continue
            name = name.replace(_SPACE, " ")
            known = kinds[-1] in (self._NORMAL, self._USER)
            self.text.append(name.encode() if known else b"")
            if known:
                self.ids[name] = i
        normal = [s for s, k in zip(score, kinds) if k == self._NORMAL]
        best, worst = max(normal), min(normal)
        # The format's rules: a user-defined piece nearly has the best score for each character, an unknown character
        # less than the worst.
        self.score = np.array([best * len(self.text[i].decode()) - 1 if k == self._USER else s
                               for i, (s, k) in enumerate(zip(score, kinds))], np.int64)
        self.values = self.score.tolist()
        self.unknown = worst - 10 * SCALE
        self.reach = max(map(len, self.ids))
        self._flatten()
        self.cuts = all(" " not in p[1:] or not p.strip(" ") for p in self.ids)
        self.table = np.array(self.text, object)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tree"}

    def __getattr__(self, name: str):
        if name != "tree":
            raise AttributeError(name)
        # The pieces as a tree of characters; key 0 of a node has the id and score of the piece that ends there.
        self.tree: dict = {}
        for piece, i in self.ids.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[0] = (i, self.values[i])
        return self.tree

    def _flatten(self) -> None:
        """The tree once more, as a hash table of steps (node and character to node) and the piece that ends at each node."""
        letters = {c: i + 1 for i, c in enumerate(sorted({c for p in self.ids for c in p}))}
        self.letter = np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.uint32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        nodes, steps, ends = [self.tree], [], [-1]
        for i, node in enumerate(nodes):
            for c, below in node.items():
                if c == 0:
                    ends[i] = below[0]
                else:
                    steps.append((i * (len(letters) + 1) + letters[c], len(nodes)))
                    nodes.append(below)
                    ends.append(-1)
        self.ends, self.letters = np.array(ends, np.int64), len(letters) + 1
        self.slots = max(4, (4 * len(steps) - 1).bit_length())
        codes, to = (np.array([x[k] for x in steps], np.int64) for k in (0, 1))
        self.codes, self.to = np.full(1 << self.slots, -1, np.int64), np.zeros(1 << self.slots, np.int32)
        left, at = np.arange(len(codes)), self._slot(codes)
        self.probes = 0
        while len(left):
            # Of those that want one free slot the last written has it, the others go one further.
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[left[free]]
            placed = self.codes[at] == codes[left]
            self.to[at[placed]] = to[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.slots) - 1)
            self.probes += 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there is none."""
        codes = nodes * self.letters + letters
        at, out = self._slot(codes), np.zeros(len(codes), np.int64)
        left = np.arange(len(codes))
        for _ in range(self.probes):
            there = self.codes[at]
            hit = there == codes[left]
            out[left[hit]] = self.to[at[hit]]
            more = ~hit & (there >= 0)
            left, at = left[more], (at[more] + 1) & ((1 << self.slots) - 1)
            if not len(left):
                break
        return out

    def solve_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each word, scores): what `word` gives for each, for many short ones at once. The places of all
        words lie in one row; pieces are laid from place to place in the order of their distance from the word's beginning."""
        size = np.array([len(w) for w in words], np.int64)
        letters = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        own = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        inside = np.arange(len(letters)) - first[own]
        place = np.arange(len(letters)) + own
        rest = size[own] - inside
        known = np.zeros(len(letters), bool)
        begins, lengths, pieces = [], [], []
        at, node = np.flatnonzero(letters), np.zeros(np.count_nonzero(letters), np.int64)
        for n in range(1, self.reach + 1):
            node = self._step(node, letters[at + n - 1])
            on = node > 0
            at, node = at[on], node[on]
            piece = self.ends[node]
            full = piece >= 0
            begins.append(at[full])
            lengths.append(np.full(len(begins[-1]), n))
            pieces.append(piece[full])
            if n == 1:
                known[begins[0]] = True
            on = rest[at] > n
            at, node = at[on], node[on]
            if not len(at):
                break
        strange = np.flatnonzero(~known)
        begin = np.concatenate([*begins, strange])
        piece = np.concatenate([*pieces, np.full(len(strange), -1)])
        reach = np.concatenate([*lengths, np.ones(len(strange), np.int64)])
        gain = np.where(piece >= 0, self.score[piece], self.unknown)
        order = np.argsort(inside[begin].astype(np.uint16), kind="stable")
        begin, piece, reach, gain = begin[order], piece[order], reach[order], gain[order]
        steps = np.searchsorted(inside[begin], np.arange(int(size.max(initial=0)) + 1))
        start = first + np.arange(len(words))
        best = np.full(len(letters) + len(words), NEVER, np.int64)
        back, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[start] = 0
        for lo, hi in zip(steps, [*steps[1:], len(begin)]):
            a = place[begin[lo:hi]]
            b, score = a + reach[lo:hi], best[a] + gain[lo:hi]
            better = score > best[b]
            b = b[better]
            best[b], back[b], last[b] = score[better], a[better], piece[lo:hi][better]
        # Back from all ends at once; a character without a piece is written as its bytes.
        end, todo, found = start + size, np.arange(len(words)), []
        scores = best[end]
        while len(todo):
            todo = todo[end[todo] > start[todo]]
            here = end[todo]
            found.append((todo, last[here], back[here]))
            end[todo] = back[here]
        out, numbers = [], np.zeros(len(words), np.int64)
        for nth, (word, piece, at) in enumerate(found):
            odd = np.flatnonzero(piece < 0)
            for i in odd.tolist():
                w = int(word[i])
                codes = [self.byte_ids[b] for b in words[w][int(at[i] - start[w])].encode("utf-8", "replace")]
                out.append((np.full(len(codes), w), np.full(len(codes), nth), -np.arange(len(codes)), np.array(codes)))
            word, piece = word[piece >= 0], piece[piece >= 0]
            out.append((word, np.full(len(word), nth), np.zeros(len(word), np.int64), piece))
        if not out:
            return np.empty(0, np.int32), numbers, scores
        word, nth, byte, ids = (np.concatenate([o[k] for o in out]) for k in range(4))
        order = np.lexsort((-byte, -nth, word))
        return ids[order].astype("<i4"), np.bincount(word, minlength=len(words)), scores

    def solve_all(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """`solve` for many texts: their distinct words are solved once."""
        number = _Numbers()
        get, split = number.__getitem__, [self._words_of(t) for t in texts]
        index = np.fromiter((get(w) for words in split for w in words), np.int64)
        whole = [w[0] if isinstance(w, tuple) else f" {w}" for w in number]
        ids, counts, scores = [], np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)
        short = [i for i, w in enumerate(whole) if len(w) <= LONGEST]
        order = []
        for lo in range(0, len(short), WORDS):
            some = short[lo:lo + WORDS]
            own, counts[some], scores[some] = self.solve_words([whole[i] for i in some])
            ids.append(own)
            order += some
        for i, w in enumerate(whole):
            if len(w) > LONGEST:
                own, scores[i] = self.word(w)
                ids.append(np.frombuffer(own, "<i4"))
                counts[i] = len(ids[-1])
                order.append(i)
        flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
        begin = np.zeros(len(whole), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        out, at = [], 0
        for words in split:
            own = index[at:at + len(words)]
            at += len(words)
            many = counts[own]
            place = np.repeat(begin[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            out.append((flat[place].tobytes(), int(scores[own].sum())))
        return out

    def _words_of(self, text: str) -> list:
        """The words of a text that begins and ends at cuts: each without the space before it, or in a tuple if there is none."""
        if not self.cuts:
            return [(text,)] if text else []
        if text[:1] == " " and "  " not in text:
            return text[1:].split(" ")
        return [w[1:] if w[0] == " " else (w,) for w in _WORD.findall(text)]

    def paths(self, text: str, begin: dict[int, int], end: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Best scores to reach each place of `text` from places in `begin` (with their scores), with pieces that begin
        before `end`; and for each place the beginning and id of its last piece (the longest of equally good ones)."""
        n, tree = len(text), self.tree
        best, back = [NEVER] * (n + 1), [(-1, -1)] * (n + 1)
        for place, s in begin.items():
            best[place] = s
        for i in range(min(end, n)):
            here, node, single = best[i], tree, False
            if here == NEVER:
                continue
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                found = node.get(0)
                if found is not None:
                    single |= j == i
                    if here + found[1] > best[j + 1]:
                        best[j + 1], back[j + 1] = here + found[1], (i, found[0])
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, (i, -1)
        return best, back

    def trace(self, text: str, back: list[tuple[int, int]], begin: int, end: int) -> bytes:
        out = []
        while end > begin:
            i, k = back[end]
            out += [k] if k >= 0 else [self.byte_ids[b] for b in reversed(text[i:end].encode())]
            end = i
        return np.array(out[::-1], "<i4").tobytes()

    def word(self, word: str) -> tuple[bytes, int]:
        """Ids and score of a text that is solved alone: what `paths` and `trace` give, for the many short ones."""
        n, unknown, tree = len(word), self.unknown, self.tree
        best, begin, piece = [0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, node, single = best[i], tree, False
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                found = node.get(0)
                if found is not None:
                    single |= j == i
                    s = here + found[1]
                    if s > best[j + 1]:
                        best[j + 1], begin[j + 1], piece[j + 1] = s, i, found[0]
            if not single and here + unknown > best[i + 1]:
                best[i + 1], begin[i + 1], piece[i + 1] = here + unknown, i, -1
        out, end = [], n
        while end:
            i, k = begin[end], piece[end]
            if k >= 0:
                out.append(k)
            else:
                out += [self.byte_ids[b] for b in reversed(word[i:end].encode())]
            end = i
        out.reverse()
        return struct.pack(f"<{len(out)}i", *out), best[n]

    def solve(self, text: str) -> tuple[bytes, int]:
        """Ids and score of a text that begins and ends at cuts."""
        return self.solve_all([text])[0]

    def middle(self, text: str, size: int) -> tuple[int, int]:
        """The first and last cut of a chunk that all of its segmentations go through; (-1, -1) without."""
        if not self.cuts:
            return -1, -1
        at = [m.start() + 1 for m in re.finditer("[^ ] ", text[:size + 1])]
        at = [p for p in at if self.reach - 1 <= p <= size]
        return (at[0], at[-1]) if at else (-1, -1)

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Scores from each state before a chunk (the first `size` characters) to each state behind it."""
        r = self.reach
        first, last = self.middle(text, size)
        out = np.full((r, r), NEVER, np.int64)

        def ends(best):
            return [best[size + j] if size + j < len(best) else NEVER for j in range(r)]

        if first < 0:
            for i in range(r):
                if i <= size:
                    out[i] = ends(self.paths(text, {i: 0}, size)[0])
                if i >= size:
                    out[i, i - size] = max(out[i, i - size], 0)
            return out
        head = [self.paths(text[:first], {i: 0}, first)[0][first] for i in range(r)]
        tail = [s for s in self.paths(text[last:], {0: 0}, size - last)[0]]
        tail = [tail[size - last + j] if size - last + j < len(tail) else NEVER for j in range(r)]
        whole = self.solve(text[first:last])[1]
        return np.maximum(np.array(head)[:, None] + whole + np.array(tail)[None, :], NEVER)

    def between(self, text: str, size: int, enter: int, leave: int) -> tuple[bytes, int]:
        """Ids and score of the pieces that begin in a chunk on a best path from one state to another."""
        def part(text: str, begin: int, end: int, before: int) -> tuple[bytes, int]:
            best, back = self.paths(text, {begin: 0}, before)
            return self.trace(text, back, begin, end), best[end]

        first, last = self.middle(text, size)
        if enter >= size:
            return b"", 0
        if first < 0:
            return part(text, enter, size + leave, size)
        parts = [part(text[:first], enter, first, first), self.solve(text[first:last]),
                 part(text[last:], 0, size - last + leave, size - last)]
        return b"".join(ids for ids, _ in parts), sum(s for _, s in parts)

    def decode(self, ids: bytes) -> str:
        """The text that these ids stand for; the space put before every text is dropped."""
        data = b"".join(self.table[np.frombuffer(ids, "<i4")].tolist())
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word) -> int:
        self[word] = out = len(self)
        return out


def _written(text: str) -> str:
    """A text as the model sees it: a space before it, none for an empty one."""
    return f" {text}" if text else ""


def _encode_short(block, text_col: str, names: dict[str, str]):
    def run(batches):
        pieces = shared(block)
        for batch in cut(batches, text_col, BATCH, ROWS):
            found = pieces.solve_all([_written(t or "") for t in batch.column(text_col).to_pylist()])
            added = {"ids": pa.array([f[0] for f in found], pa.binary()), "score": pa.array([f[1] for f in found], pa.int64())}
            if "decoded" in names:
                added["decoded"] = pa.array([pieces.decode(f[0]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()],
                                             names=[*batch.schema.names, *[names[n] for n in added]])

    return run


def starts_of(text: str, chunk: int, cuts: bool) -> list[int]:
    """Where the chunks of a text begin, and its end: at most `chunk` characters apart, between words where words are shorter."""
    out = [0]
    while out[-1] < len(text):
        end = min(out[-1] + chunk, len(text))
        while cuts and end < len(text) and end > out[-1] and not (text[end] == " " and text[end - 1] != " "):
            end = text.rfind(" ", out[-1], end)
        out.append(end if end > out[-1] else min(out[-1] + chunk, len(text)))
    return out


def _split(reach: int, cuts: bool, chunk: int):
    def run(batches):
        for batch in cut(batches, "text", BATCH, ROWS):
            for r in batch.to_pylist():
                text = _written(r["text"])
                at = starts_of(text, chunk, cuts)
                for lo in range(0, len(at) - 1, 256):
                    some = [{"key": r["key"], "nth": lo + k, "n": len(at) - 1, "size": b - a, "text": text[a:b + reach - 1]}
                            for k, (a, b) in enumerate(zip(at[lo:lo + 256], at[lo + 1:]))]
                    yield pa.RecordBatch.from_pylist(some, _PARTS)

    return run


_PARTS = pa.schema([("key", pa.string()), ("nth", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("text", pa.string())])
_CHUNKS = "key string, nth long, n long, size long, text string"


def _matrices(block):
    def run(batches):
        pieces = shared(block)
        for batch in cut(batches, "text", BATCH, ROWS):
            rows = [pieces.matrix(r["text"], r["size"]).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("nth"), batch.column("n"), pa.array(rows, pa.binary())],
                names=["key", "nth", "n", "m"])

    return run


def _multiply(group: pa.Table) -> pa.Table:
    """One matrix for up to FAN neighbours."""
    rows = sorted(group.to_pylist(), key=lambda r: r["nth"])
    side = int((len(rows[0]["m"]) // 8) ** 0.5)
    out = None
    for r in rows:
        m = np.frombuffer(r["m"], np.int64).reshape(side, side)
        out = m if out is None else product(out, m)
    return pa.Table.from_pylist([{"key": rows[0]["key"], "nth": rows[0]["nth"] // FAN, "n": -(-rows[0]["n"] // FAN),
                                  "m": out.tobytes()}], _MATRIX)


_MATRIX = pa.schema([("key", pa.string()), ("nth", pa.int64()), ("n", pa.int64()), ("m", pa.binary())])
_STATE = pa.schema([("key", pa.string()), ("nth", pa.int64()), ("enter", pa.int64()), ("leave", pa.int64())])


def _descend(members: pa.Table, above: pa.Table) -> pa.Table:
    """The states between a group's members, from those at its ends."""
    rows = sorted(members.to_pylist(), key=lambda r: r["nth"])
    enter, leave = above.column("enter")[0].as_py(), above.column("leave")[0].as_py()
    side = int((len(rows[0]["m"]) // 8) ** 0.5)
    best = np.full(side, NEVER, np.int64)
    best[enter] = 0
    backs = []
    for r in rows:
        through = best[:, None] + np.frombuffer(r["m"], np.int64).reshape(side, side)
        backs.append(through.argmax(axis=0))
        best = np.maximum(through.max(axis=0), NEVER)
    out, state = [], leave
    for r, back in zip(reversed(rows), reversed(backs)):
        before = int(back[state])
        out.append({"key": r["key"], "nth": r["nth"], "enter": before, "leave": state})
        state = before
    return pa.Table.from_pylist(out, _STATE)


def boundary_states(matrices: DataFrame) -> DataFrame:
    """(key, nth, enter, leave) of each chunk on a best path through its text.

    `matrices` has key, nth (from 0), n (chunks of the text) and m. No group has more than FAN rows; the number of
    levels is the logarithm of the longest text."""
    levels = [matrices]
    longest = matrices.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        up = levels[-1].withColumn("g", F.floor(F.col("nth") / FAN)).groupBy("key", "g").applyInArrow(
            lambda t: _multiply(t.drop_columns("g")), "key string, nth long, n long, m binary")
        levels.append(stored(up, "matrices"))
        longest = -(-longest // FAN)
    zero = F.lit(0).cast("long")
    states = levels[-1].select("key", "nth", zero.alias("enter"), zero.alias("leave"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("g", F.floor(F.col("nth") / FAN))
        above = states.withColumnRenamed("nth", "g")
        states = own.groupBy("key", "g").cogroup(above.groupBy("key", "g")).applyInArrow(
            lambda a, b: _descend(a, b), "key string, nth long, enter long, leave long")
    return states


def _trace(block):
    def run(batches):
        pieces = shared(block)
        for batch in cut(batches, "text", BATCH, ROWS):
            found = [pieces.between(r["text"], r["size"], r["enter"], r["leave"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("nth"), pa.array([f[0] for f in found], pa.binary()),
                 pa.array([f[1] for f in found], pa.int64())], names=["key", "nth", "ids", "score"])

    return run


def _whole(block, check: bool):
    """The chunks of one text, in order, and with `check` what its ids stand for."""

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["nth"])
        ids = b"".join(r["ids"] for r in rows)
        out = {"key": [rows[0]["key"]], "ids": pa.array([ids], pa.binary()), "score": [sum(r["score"] for r in rows)]}
        return pa.table(out | ({"decoded": [shared(block).decode(ids)]} if check else {}))

    return join


def _decoded(block, ids_col: str, out_col: str):
    def run(batches):
        pieces = shared(block)
        for batch in cut(batches, ids_col, BATCH, ROWS):
            texts = [None if i is None else pieces.decode(i) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out_col])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, model_file: str, text_col: str = "text", chunk: int = CHUNK,
           check: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with `ids` (little-endian signed 32-bit numbers) and `score` (sum of scores, times SCALE), and with `check` the
    text `decoded` from the ids; their names come with it. Null and empty texts have no ids. Equal giant texts are encoded once, and found again by their hash and
    length. Of several segmentations with the greatest score one is taken by a fixed rule (see the module). A U+2581 of the text
    is written as bytes, so that decoding gives every text back. Rows, repeated ones too, and other columns stay."""
    names = {n: fresh(docs, n) for n in ["ids", "score"] + ["decoded"] * check}
    pieces = Pieces(model_file)
    block = share(docs.sparkSession, pieces)
    key = fresh(docs, "text_key")
    giant = F.coalesce(F.length(text_col), F.lit(0)) > chunk
    added = f"`{names['ids']}` binary, `{names['score']}` long" + (f", `{names['decoded']}` string" if check else "")
    short = docs.where(~giant).mapInArrow(_encode_short(block, text_col, names), f"{_ddl(docs)}, {added}")
    giants = docs.where(giant).withColumn(key, F.concat_ws("-", F.sha2(text_col, 256), F.length(text_col)))
    once = giants.select(F.col(key).alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    chunks = stored(once.mapInArrow(_split(pieces.reach, pieces.cuts, chunk), _CHUNKS), "chunks")
    matrices = stored(chunks.mapInArrow(_matrices(block), "key string, nth long, n long, m binary"), "matrices")
    states = boundary_states(matrices)
    traced = chunks.join(states, ["key", "nth"]).select("key", "nth", "size", "text", "enter", "leave").mapInArrow(
        _trace(block), "key string, nth long, ids binary, score long")
    whole = traced.groupBy("key").applyInArrow(
        _whole(block, check), "key string, ids binary, score long" + ", decoded string" * check)
    whole = whole.select(F.col("key").alias(key), *[F.col(n).alias(own) for n, own in names.items()])
    return short.unionByName(giants.join(whole, key).drop(key)), names


def decode(encoded: DataFrame, model_file: str, ids_col: str, out_col: str) -> DataFrame:
    """`encoded` with the text of each row's ids; null ids have none."""
    block = share(encoded.sparkSession, Pieces(model_file))
    return encoded.mapInArrow(_decoded(block, ids_col, out_col), f"{_ddl(encoded)}, `{out_col}` string")


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, score, ids_sha256 and round_trip (decoding gives the text back) of every document."""
    back, names = encode(docs.select("doc_id", "text"), model_file, check=True)
    return back.select(
        "doc_id", (F.length(names["ids"]) / 4).cast("long").alias("n_tokens"), F.col(names["score"]).alias("score"),
        F.sha2(names["ids"], 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
