"""URL filter: a blocked Bloom filter passes possible hits to an exact join with the listed prefixes.

All steps are DataFrame functions. A rule is a canonical prefix `host || path`; it fits a url whose host is the
rule's or a subdomain of it and whose path starts with the rule's. For each shape of a rule that occurs (number
of host labels, length of path) a url has at most one prefix, found by a join with the table of shapes. The filter
is split into blocks of four 64-bit words, and a key sets or tests one bit of each word of one block."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, power_of_two

#: Listed prefixes for each block of 256 bits (a missing one then passes with a chance of about 0.003), and how many blocks are broadcast.
ROOM, LEAST, SENT = 16, 1 << 10, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = ["w0", "w1", "w2", "w3"]


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a text without `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the key's block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(len(WORDS))]


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter of the rules' keys: at most `blocks` rows (block, w0..w3)."""
    bits = _bits(F.col("rule"))
    return (
        rules.select(_place(F.col("rule"), blocks).alias("block"), *[b.alias(w) for b, w in zip(bits, WORDS)])
        .groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", blocks: int | None = None,
                otherwise: str = "allow") -> DataFrame:
    """All columns of `pages` and host, path, rule, verdict; columns of these names are replaced.

    `rules` has host, path and verdict (the listed prefixes; rows with a null in host or path are left out, of
    repeated ones the smallest verdict counts). The longest fitting rule gives the verdict, the greater text
    among equally long ones; a url that none fits gets `otherwise`. Null urls and those without a
    host are kept. An empty list or table is fine. The filter has a block of 40 bytes for every ROOM listed prefixes (or `blocks`)
    and is broadcast up to SENT blocks; beyond that, and for the list itself, Spark joins as it sees fit for the size, after equal
    urls have been put together. Runs a job that counts the list."""
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = canonical(F.col(url_col))
    seen = pages.select(*own, host.alias("host"), path.alias("path"))
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    )
    blocks = blocks or max(LEAST, power_of_two(listed.count() / ROOM))
    # Shapes, a row for each number of labels (127 at most) with the lengths of path listed for it.
    shapes = listed.groupBy(_labels(F.col("host")).alias("n")).agg(F.collect_set(F.length("path")).alias("lengths"))
    urls = seen.select("host", "path").where(F.col("host") != "").distinct().withColumn(
        "n", F.explode(F.sequence(F.lit(1), _labels(F.col("host")))))
    fitting = F.filter("lengths", lambda m: m <= F.length("path"))
    probes = (
        urls.join(F.broadcast(shapes), "n").select("host", "path", "n", F.explode(fitting).alias("m"))
        .select("host", "path", F.concat(F.expr("substring_index(host, '.', -n)"), F.expr("substring(path, 1, m)")).alias("key"))
        .withColumn("block", _place(F.col("key"), blocks))
    )
    all_set = F.lit(True)
    for word, bit in zip(WORDS, _bits(F.col("key"))):
        all_set = all_set & (F.col(word).bitwiseAND(bit) != 0)
    words = bloom_filter(listed, blocks)
    possible = probes.join(F.broadcast(words) if blocks <= SENT else words, "block").where(all_set)
    hits = possible.select("host", "path", F.col("key").alias("rule")).join(listed.select("rule", "verdict"), "rule")
    best = fresh(seen, "best")
    longest = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(best))
    return seen.join(longest, ["host", "path"], "left").select(
        *own, "host", "path", F.col(best)["rule"].alias("rule"),
        F.coalesce(F.col(best)["verdict"], F.lit(otherwise)).alias("verdict"))
