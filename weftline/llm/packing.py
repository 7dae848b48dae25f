"""Packing by lexical retrieval.

Documents become token ids; full windows of a long document stand alone, and the tails are spread
over shards. Each shard holds a BM25 inverted index of its tails (terms are token ids,
document frequencies are those of all documents): the first unused tail is a seed, the index returns
its unused neighbours by all of the seed's terms, best first, and they fill the seed's window greedily: each that fits whole
is taken, then the best that is left is cut, and its rest goes back to the pool. So every window is full; what is left of a
shard at last is cut into sequences whose lengths are powers of two, which need no padding.

A shard has about SHARD_TOKENS tokens, so a task's memory doesn't grow with the corpus. Related documents
share shards: a document's topic is the token that it repeats most for one of its rarity (topic()), topics lie on a line
one after another, each as long as its tokens, and the line is cut into shards. A topic that is larger than a shard is thus
split, by a hash of id and position, and small ones lie together.

Null texts count as empty: the end token alone. Null ids pass through, and repeated rows are packed each. No documents give no
pieces.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_rows
from weftline.session import written

WINDOW, END_ID, SHARD_TOKENS = 2048, 1, 1_000_000
#: BM25's constants.
K1, B = 1.2, 0.75

_loaded: dict = {}


class Encoder:
    """Token ids of texts by the tokenizers file, little-endian: uint16, or uint32 for a vocabulary of more than 65,536 ids.

    The same vocabulary's rank file gives the same ids faster; texts with the special token's string
    go through the tokenizers library itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.slow, self.fast, self.dtype = path, None, None, "<u2"
        if not ranks and self.tokenizer().get_vocab_size() > 1 << 16:
            self.dtype = "<u4"
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_to_numpy

    def tokenizer(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer().encode(text, add_special_tokens=False).ids, self.dtype)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.SPECIAL in text:
            return self.exact(text).tobytes()
        return self.fast(text, disallowed_special=()).astype(self.dtype).tobytes()


def encoder(path: str | None = None) -> Encoder:
    """One encoder per worker process and file; without a path, the installed byte_bpe_50k.json."""
    if path not in _loaded:
        import public_tokenizers as p

        own = p.path("byte_bpe_50k.json")
        fast = path in (None, own)
        _loaded[path] = Encoder(path or own, p.path("byte_bpe_50k.tiktoken") if fast else None, p.PATTERN if fast else None)
    return _loaded[path]


def counted(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, distinct id and its count, in order, for all rows at once."""
    size = [len(r) for r in rows]
    every = np.sort(np.repeat(np.arange(len(rows), dtype=np.uint64), size) << np.uint64(32) | np.concatenate(rows).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return (every[first] >> np.uint64(32)).astype(np.int64), (every[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.concatenate((first, [len(every)])))


def topics(rows: list[np.ndarray]) -> list[int]:
    """By row, the token that tells most of what its ids are about: repeated, and rare (a tokenizer's higher ids are merges of rarer strings); ties: the least."""
    row, t, n = counted(rows)
    weight = n / (n + K1) * np.log(2.0 + t)
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, begin), np.diff(np.concatenate((begin, [len(row)])))))
    _, first = np.unique(row[best], return_index=True)
    return t[best[first]].tolist()


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``row`` (its place in its task), ``n``, ``topic`` and ``ids`` (Encoder's, with END_ID) of every row, as a written table."""

    def run(lists):
        encode, row = encoder(tokenizer), 0
        end = np.array([END_ID], encode.dtype).tobytes()
        for rows in lists:
            ids = [encode(r[1] or "") + end for r in rows]
            own = [np.frombuffer(x, encode.dtype) for x in ids]
            yield [(r[0], row + i, len(o), t, x) for i, (r, o, t, x) in enumerate(zip(rows, own, topics(own), ids))]
            row += len(rows)

    return written(map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, row long, n long, topic int, ids binary"), "token-ids")


def frequencies(tokens: DataFrame, dtype: str = "<u2") -> np.ndarray:
    """In how many rows each token id occurs; as many numbers as the vocabulary has, whatever the corpus."""

    def run(lists):
        df = np.zeros(1 << 16, np.int64)
        for rows in lists:
            one = np.bincount(counted([np.frombuffer(r[1], dtype) for r in rows])[1], minlength=len(df))
            one[: len(df)] += df
            df = one
        at = np.flatnonzero(df)
        yield list(zip(at.tolist(), df[at].tolist()))

    found = map_rows(tokens.select("n", "ids"), run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(max([1 << 16, *(r.id + 1 for r in found)]), np.int64)
    for r in found:
        out[r.id] = r.df
    return out


class Index:
    """BM25 over the tails of one shard: postings (tail, weight) by term; those of used tails go each time a fifth are used."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, term, n = counted(tails)
        length = np.array([len(t) for t in tails])
        weight = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[doc] / mean))
        self.n, self.size, self.indexed = len(tails), len(idf), len(tails)
        self.query = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        order = np.argsort(term, kind="stable")
        self._set(term[order], doc[order], weight[order])

    def _set(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight = term, doc, weight
        self.at = np.searchsorted(term, np.arange(self.size + 1)).tolist()

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share a term with the seed, best first (ties: the earlier)."""
        left = int(unused.sum())
        if 5 * left < 4 * self.indexed:
            on = unused[self.doc]
            self._set(self.term[on], self.doc[on], self.weight[on])
            self.indexed = left
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed].tolist()]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of ``docs`` once."""
    out = [[(i, at, window)] for i, d in enumerate(docs) for at in range(0, len(d) - window + 1, window)]
    tails = [(i, len(d) - len(d) % window) for i, d in enumerate(docs) if len(d) % window]
    if not tails:
        return out
    index = Index([docs[i][a:] for i, a in tails], idf, mean)
    start = np.array([a for _, a in tails])  # moves as a tail is cut
    end = np.array([len(docs[i]) for i, _ in tails])
    unused, first = np.ones(len(tails), bool), 0
    while True:
        while first < len(tails) and not unused[first]:
            first += 1
        if first == len(tails):
            break
        row, room = [], window

        def put(t: int, n: int):
            nonlocal room
            row.append((tails[t][0], int(start[t]), n))
            start[t] += n
            room -= n
            unused[t] = start[t] < end[t]

        put(first, min(room, int(end[first] - start[first])))
        near = index.neighbours(first, unused) if room else np.zeros(0, int)
        sizes, at = end[near] - start[near], 0
        while room and (whole := np.flatnonzero(sizes[at:] <= room)[:1]).size:  # the next best that fits
            at += int(whole[0])
            put(int(near[at]), int(sizes[at]))
            at += 1
        rest = (t for part in (near.tolist(), range(first, len(tails))) for t in part)
        while room and (t := next(rest, None)) is not None:
            if unused[t]:
                put(t, min(room, int(end[t] - start[t])))
        while room and len(row) and room < window:  # the shard's last: powers of two
            size = 1 << (window - room).bit_length() - 1
            part, left = [], size
            while left:
                d, a, n = row.pop(0)
                part.append((d, a, min(n, left)))
                if n > left:
                    row.insert(0, (d, a + left, n - left))
                left -= min(n, left)
            out.append(part)
            room += size
        if row:
            out.append(row)
    return out


def sharded(tokens: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int, int]:
    """``tokens`` with a ``shard``, and how many rows and tokens there are. One number a topic comes to the driver: a vocabulary at most."""
    sizes = tokens.groupBy("topic").agg(F.sum("n").alias("size"), F.count("*").alias("rows")).orderBy("topic").collect()
    line, at = [], 0
    for r in sizes:
        line.append((r.topic, at, r["size"]))
        at += r["size"]
    places = F.broadcast(tokens.sparkSession.createDataFrame(line, "topic int, begin long, size long"))
    place = F.col("begin") + F.pmod(F.xxhash64("doc_id", "row", "n"), F.col("size"))
    return tokens.join(places, "topic").withColumn("shard", F.floor(place / shard_tokens).cast("long")).drop("begin", "size"), sum(r["rows"] for r in sizes), at


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Pieces: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned 32-bit, little-endian)."""
    tokens = encoded(docs, text, key, tokenizer)
    spread, n, total = sharded(tokens, shard_tokens)
    dtype = encoder(tokenizer).dtype
    df = frequencies(tokens, dtype)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["topic", "doc_id", "row", "ids"], na_position="first")
        ids = [np.frombuffer(x, dtype) for x in rows["ids"]]
        names, base = rows["doc_id"].tolist(), int(rows["shard"].iloc[0]) << 32
        out = []
        for s, sequence in enumerate(pack(ids, idf, max(1.0, min(window, total / max(n, 1))), window)):
            offset = 0
            for i, a, k in sequence:
                out.append((names[i], a, k, len(ids[i]), base + s, offset, ids[i][a : a + k].astype("<u4").tobytes()))
                offset += k
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        return frame.astype({"doc_id": "Int64"})

    return spread.groupBy("shard").applyInPandas(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
