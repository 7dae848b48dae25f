"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS = 3 bits have a word in the middle, at most 2 bits from
one and 1 bit from the other. So every fingerprint emits its variants: all within 1 bit, and, if its
number of ones is odd, those within 2 bits too (a pair 3 bits apart differs in parity, so one side's
second bit is enough; of three differing bits two lie in the same 32-bit half, so both flips of a
2-bit variant are taken in one half). Whoever meets at a variant of a fingerprint within 1 bit of it is
within 3 bits of that fingerprint, so a meeting point is settled by linking all to the least of
those: no pairs within a bucket, whatever its size, and still the same components.

The variants aren't shuffled one by one at first. A row holds the variants that share a half (33 rows
per fingerprint and half); the shuffle is on that half, rows whose half no other fingerprint has are
dropped, and what remains is unfolded and shuffled on the whole variant. Both shuffles are aggregates that combine
first; what they find is joined back, and keys with very many fingerprints are joined without a shuffle.

That first filter helps while two fingerprints seldom share a half by chance: with n different ones, each has about
n / 2**32 others in each of its 66 half words, so beyond some 10**8 of them most are unfolded, into about 1,150 variants for
those with an odd number of ones.

Null and wordless texts have the fingerprint zero, which links like any other. Rows with a null id link like
others, but give no component its id and have a null component themselves. Repeated rows are returned each. No rows give no
rows. deduplicated() orders null ids last, and rows of one id by their row_key().
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_ROWS, join_hot, map_rows, row_key, without
from weftline.llm.graph import components
from weftline.session import checkpoint, written

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a task before they are unfolded into half words.
TASK_ROWS = 16_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z, and \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE]))
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and the long columns ``keys`` of every row."""

    def run(lists):
        for rows in lists:
            f = np.array([fingerprint(r[1]) for r in rows], np.uint64).view(np.int64).tolist()
            yield [(r[0], x, *r[2:]) for r, x in zip(rows, f)]

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *keys)
    return map_rows(own, run, "doc_id long, fp long" + "".join(f", {k} long" for k in keys))


def _within(word, upto: int):
    """Array of structs (w, r): the words within ``upto`` bits of a 32-bit word, r bits away."""
    flips = [(0, 0)] + [(1 << i, 1) for i in range(32)] + ([(1 << i | 1 << j, 2) for i in range(32) for j in range(i)] if upto == 2 else [])
    masks = F.lit(np.array([m for m, _ in flips], np.int64).tolist()).cast("array<bigint>")
    return F.transform(masks, lambda m: F.struct(word.bitwiseXOR(m).alias("w"), F.bit_count(m).cast("int").alias("r")))


def links(fps: DataFrame, fp: str = "fp", hot: int | None = None, near: int = BROADCAST_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints within RADIUS bits that give the components of all such pairs.

    Up to ``near`` shared halves or centres are broadcast to the rows that they are joined with; more are joined by a shuffle.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    one = checkpoint(fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct())
    n = one.count()
    one = one.repartition(int(min(20_000, max(fps.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS))))
    halves = one.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("tag"), high.alias("key"), low.alias("rest")), F.struct(F.lit(1).alias("tag"), low.alias("key"), high.alias("rest")))).alias("h"))
    folded = halves.select("fp", "h.tag", "h.rest", F.explode(_within(F.col("h.key"), 1)).alias("k")).select("fp", "tag", "rest", F.col("k.w").alias("key"), F.col("k.r").alias("flips"))
    shared = written(folded.groupBy("tag", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count("*").alias("n")).where("least <> most").select("tag", "key", "n"), "halves")
    met = join_hot(folded, shared, ["tag", "key"], "n", 66 * n, hot, near)
    unfolded = met.select("fp", "tag", "key", "flips", F.explode(F.when(F.col("flips") == 1, F.array(F.struct(F.col("rest").alias("w"), F.lit(0).alias("r")))).when(F.bit_count("fp") % 2 == 1, _within(F.col("rest"), 2)).otherwise(_within(F.col("rest"), 1))).alias("x"))
    at = unfolded.select("fp", "tag", "key", F.col("x.w").alias("w"), (F.col("flips") + F.col("x.r")).alias("r"))
    centres = at.groupBy("tag", "key", "w").agg(F.min(F.when(F.col("r") <= 1, F.col("fp"))).alias("b"), F.count("*").alias("m")).where("b is not null and m > 1")
    near = join_hot(at, written(centres, "centres"), ["tag", "key", "w"], "m", None, hot, near).where("b <> fp")
    return near.select(F.col("fp").alias("a"), "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def roots(each: DataFrame) -> DataFrame:
    """``fp, root, n``: of every fingerprint in ``each``, the least (signed) one reachable by links, and its rows."""
    own = checkpoint(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    root = components(links(own))
    return own.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the least id reachable by links) for every row."""
    each = checkpoint(fingerprints(docs, text, key))
    named = roots(each)
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(whole, "root").select("fp", "n", "component_id")
    return join_hot(each, checkpoint(by_fp), ["fp"], "n").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group: that with the least id (null ids last, then row_key()).

    Rows are told apart by row_key(), not by their id: rows that share an id but are no near-duplicates all stay. Only keys
    are shuffled; texts are read again and passed on where they are.
    """
    each = checkpoint(fingerprints(docs.select(F.col(key).alias(key), F.col(text).alias(text), *row_key(docs)), text, key, ("k1", "k2")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    rows = each.groupBy("k1", "k2").agg(F.first("fp").alias("fp"), F.first("doc_id").alias("doc_id"), F.count("*").alias("times"))  # a key has one text and one id
    by_fp = checkpoint(roots(each).select("fp", "root", F.col("n").alias("m")))
    placed = checkpoint(join_hot(rows, by_fp, ["fp"], "m"))
    first = checkpoint(placed.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("size")))
    told = join_hot(placed, first, ["root"], "size").select("k1", "k2", "times", rank.eqNullSafe(F.col("first")).alias("stays"))
    told = written(told.where("not stays or times > 1"), "copies")
    return without(docs, told.where("not stays"), told.where("stays"))


def op7(docs: DataFrame) -> DataFrame:
    out = groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
