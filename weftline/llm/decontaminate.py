"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may be met with up to e = floor(RATE * L) edits. It is split into e + 1
pieces; with e edits at least one piece is untouched, so an Aho-Corasick pass over the whole text for
all pieces finds a place of every such occurrence, and Myers' bit-parallel distance over the window
around that place decides. Both sides are lower-cased and their white space made single spaces first.

The items are taken in blocks of at most BLOCK_CHARS characters, each a pass of its own over the
documents, so what a task or the driver holds is bounded whatever the size of the benchmark: with more than one
block, a block's matches are written before the next block is read. Null or blank items
match nothing; null and empty texts hold nothing. Items too short for an edit (under 13 characters) match
as whole words only. Repeated items and rows are each reported; null ids pass through. No rows or no items give no matches.
"""

from __future__ import annotations

import itertools

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import filter_texts, map_rows, row_key, without
from weftline.session import written

RATE, BLOCK_CHARS = 0.08, 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(rate * length)


def myers(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    if peq is None:
        peq = masks(pattern)
    m = len(pattern)
    every, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = every, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (every & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & every
        mv = ph & xv & every
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds the items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items, pieces = [], {}
        for key, text in items:
            text = normal(text)
            if not text:
                continue
            n, e = len(text), budget(len(text), rate)
            self.items.append((key, text, e, masks(text)))
            for j in range(e + 1):
                a, b = j * n // (e + 1), (j + 1) * n // (e + 1)
                pieces.setdefault(text[a:b], []).append((len(self.items) - 1, a))
        self.found = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.found.add_word(piece, (len(piece), where))
        if pieces:
            self.found.make_automaton()

    def match(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, distance, end in the normal text) of the closest place of each item that is there."""
        text, best, tried = normal(text), {}, set()
        if not self.items or not text:
            return []
        for last, (size, where) in self.found.iter(text):
            for i, offset in where:
                start = last + 1 - size - offset
                if (i, start) in tried or i in best and best[i][0] == 0:
                    continue
                tried.add((i, start))
                _, item, e, peq = self.items[i]
                n = len(item)
                if start >= 0 and text.startswith(item, start):
                    if e or (start == 0 or text[start - 1] == " ") and (start + n == len(text) or text[start + n] == " "):
                        best[i] = (0, start + n)
                elif e:
                    low = max(0, start - e)
                    d, end = myers(item, text[low : max(0, start + n + e)], peq)
                    if d <= e and (i not in best or d < best[i][0]):
                        best[i] = (d, low + end)
        return [(self.items[i][0], d, end) for i, (d, end) in sorted(best.items())]


def blocks(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS):
    """The items as lists of (id, text), each of about ``block_chars`` characters (one item at least)."""
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").withColumn("n", F.length("text"))
    shares = max(1, -(-items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // block_chars))
    if shares > 1:
        items = items.withColumn("share", F.pmod(F.xxhash64("item_id", "text"), F.lit(shares))).sort("share", "item_id", "text")
    own, size = [], 0
    for r in items.toLocalIterator():
        if own and size + r.n > block_chars:
            yield own
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += r.n
    if own:
        yield own


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``end_at``: one row for each document and item it holds."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _found(own, blocks(benchmark, item, item_text, block_chars), "doc_id long", rate).select("doc_id", "item_id", "distance", "end_at")


def _found(texts: DataFrame, every, keys: str, rate: float) -> DataFrame:
    """Matches of the items in the blocks ``every``, with the columns ``keys`` of ``texts`` (all but its second, the text)."""
    out, schema, before = None, f"{keys}, item_id long, distance int, end_at long", None

    def part(items):
        def run(lists):
            matcher = Matcher(items, rate)
            for rows in lists:
                yield [(r[0], *r[2:], *m) for r in rows for m in matcher.match(r[1])]

        return map_rows(texts, run, schema)

    for items in every:
        if before is not None:  # one block is in hand at a time
            done = written(part(before), "matches")
            out = done if out is None else out.union(done)
        before = items
    if before is None:
        return texts.sparkSession.createDataFrame([], schema)
    return part(before) if out is None else out.union(written(part(before), "matches"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item.

    One block is a filter over the texts; with more, the row_key() of the rows that hold one is written for each block, and
    those rows are left out at last.
    """
    every = blocks(benchmark, block_chars=block_chars)
    first, second = next(every, None), next(every, None)
    if first is None:
        return docs
    if second is None:

        def make():
            matcher = Matcher(first, rate)
            return lambda texts: [not matcher.match(t) for t in texts]

        return filter_texts(docs, make, text)
    keys = row_key(docs)
    own = docs.select(keys[0], F.col(text).alias("text"), keys[1])
    return without(docs, written(_found(own, itertools.chain([first, second], every), "k1 long, k2 long", rate).select("k1", "k2").distinct(), "leaked"))


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select("doc_id", "item_id", "distance")
