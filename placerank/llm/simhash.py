"""Near-duplicates by SimHash: fingerprints, and tiled exact comparison.

Equal fingerprints are put together first. Distinct ones are sorted into cells by the population counts of their four
16-bit quarters; the counts of two fingerprints differ in sum by no more than the fingerprints differ in bits, so
only cells whose counts differ by at most the radius can hold links, and all other tile pairs are skipped. A cell
is cut into tiles of bounded size. Each remaining pair of tiles is compared whole, with exclusive-or and bit counts
over the block, and gives a spanning forest of its links: all links inside a tile pair are kept as connections, and
no group is written out as all of its pairs."""

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, texts
from .components import connected_components

WIDTH, RADIUS, TILE, SEED = 3, 3, 2048, 42
_SLICE = 1 << 16


def fingerprint(text: bytes | None, width: int = WIDTH) -> bytes:
    """Eight bytes, most significant bit first. A bit is set where over half of the word shingles' XXH64 have it."""
    from xxhash import xxh64_digest

    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    last = (ends[len(words) - n:] - 1).tolist()
    hashes = b"".join([xxh64_digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), last)])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _SLICE):
        ones += np.unpackbits(table[lo:lo + _SLICE], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _fingerprints(text_col: str, name: str, keep: list[str], width: int):
    def run(batches):
        for batch in batches:
            bits = b"".join(fingerprint(t, width) for t in texts(batch, text_col))
            column = pa.array(np.frombuffer(bits, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [column], names=[*keep, name])

    return run


def with_fingerprints(docs: DataFrame, name: str, keep: list[str], text_col: str = "text",
                      width: int = WIDTH) -> DataFrame:
    """The columns `keep` of `docs` and the fingerprint of each text as a signed long."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in [docs.schema[c]]]
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    return rows.mapInArrow(_fingerprints(text_col, name, keep, width), ", ".join([*fields, f"`{name}` long"]))


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Indexes of links that connect the same rows and columns as all of them do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), (-1 - j).tolist())):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append(k)
    return kept


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for a, b in zip(batch.column("own"), batch.column("other")):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                differ = x[i] != y[j]
                i, j = i[differ], j[differ]
                if len(i) >= len(x) + len(y):
                    kept = _forest(i, j)
                    i, j = i[kept], j[kept]
                out_a.append(x[i])
                out_b.append(y[j])
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v).view(np.int64)) for v in (out_a, out_b)], names=["a", "b"])

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column `fp` at most `radius` bits apart: enough of them to connect
    what all of them connect. Repeated and null fingerprints add nothing."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    distinct = fingerprints.where(F.col("fp").isNotNull()).select("fp").distinct()
    cell = sum(q * 17**i for i, q in enumerate(quarter)).cast("int")
    distinct = distinct.withColumn("cell", cell)
    # At most 17^4 cells, so this table is bounded.
    sizes = F.broadcast(stored(
        distinct.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts")), "cells"))
    tiles = (
        distinct.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles, "tiles")
    steps = [s for s in product(range(-radius, radius + 1), repeat=4)
             if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
    at = [F.pmod(F.floor(F.col("cell") / F.lit(17**i)), F.lit(17)).cast("int") for i in range(4)]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps]))
    moved = [at[i] + F.col("step")[i] for i in range(4)]
    inside = moved[0].between(0, 16) & moved[1].between(0, 16) & moved[2].between(0, 16) & moved[3].between(0, 16)
    asked = (
        tiles.select("cell", "part", F.col("fps").alias("own"), step.alias("step")).where(inside)
        .select(F.col("cell").alias("home"), F.col("part").alias("home_part"), "own",
                sum(m * 17**i for i, m in enumerate(moved)).cast("int").alias("cell"))
        .join(sizes, "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where((F.col("home") != F.col("cell")) | (F.col("part") >= F.col("home_part")))
    )
    pairs = asked.join(tiles.withColumnRenamed("fps", "other"), ["cell", "part"]).select("own", "other")
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def groups(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for fingerprints that link to another one."""
    return connected_components(links(fingerprints, radius)).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id",
                    keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns `keep` of every row (its id if not given) with three more, whose names are returned: `fp`
    (fingerprint as a long), `root` (the group's smallest fingerprint) and `component_id` (the smallest id in the group).

    Null and wordless texts have fingerprint 0 and link like any other. Rows with equal ids stay rows of their own. Null ids
    count for no minimum; a group of nothing else has a null component_id. Ties need no rule. `keep` is stored with the
    fingerprints, so leave texts out of it."""
    keep = keep or [id_col]
    names = {n: fresh(docs, n) for n in ("fp", "root", "component_id")}
    rows = stored(with_fingerprints(docs, names["fp"], list(dict.fromkeys([*keep, id_col])), text_col), "fingerprints")
    seen = stored(rows.groupBy(F.col(names["fp"]).alias("fp")).agg(F.min(id_col).alias("first")), "distinct")
    linked = groups(seen, radius)
    rooted = seen.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(first, "root").withColumnsRenamed(names)
    # A fingerprint that very many rows have is a lookup with one row: adaptive execution may cut its partition.
    return rows.join(by_fp, names["fp"]).select(*keep, *names.values()), names


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    rows, names = near_duplicates(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex(names["fp"])), 16, "0").alias("fingerprint"),
                       F.col(names["component_id"]).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that have their group's smallest id, one for each group."""
    key, root = fresh(docs, "text_key"), fresh(docs, "group_root")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    rows, names = near_duplicates(keyed.select("doc_id", "text", key), keep=["doc_id", key])
    # Of rows with the smallest id one text is taken, and of equal rows with that text one.
    first = rows.where(F.col("doc_id").eqNullSafe(F.col(names["component_id"]))).groupBy(F.col(names["root"]).alias(root)).agg(
        F.min(F.struct("doc_id", key)).alias("row")).select(root, F.col("row.doc_id").alias("own_id"), F.col(f"row.{key}").alias(key))
    own = fresh(docs, "own_id")
    kept = keyed.join(first.withColumnRenamed("own_id", own), key).where(F.col("doc_id").eqNullSafe(F.col(own)))
    # Only equal rows are repeated here; by the key of the join they need no further shuffle.
    return kept.dropDuplicates([key, "doc_id"]).select(*docs.columns)
