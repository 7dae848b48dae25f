"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 in DIM dimensions. An n-gram's vector binds
(multiplies) its letters' vectors, each rotated by its place; a text's vector bundles (adds) those of
its n-grams; a language's prototype bundles its training texts. A text goes to the prototype with
the largest cosine, after the mean direction of all prototypes is taken out of both.

Null and letterless texts give ``und`` with score 0. Null ids pass through. No labelled rows: ``und``
for every text. Repeated rows are scored each. Columns beside the named ones are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bucket, filter_texts, map_rows, medians
from weftline.session import written

#: Dimensions; symbols (0 for any run of non-letters, 26 Latin letters, the rest shared by hash); letters in an n-gram.
DIM, SYMBOLS, N = 1024, 128, 3
UNDETERMINED = "und"
#: Languages whose sums a task holds at once while it learns.
FIT_LANGUAGES = 512
#: A text is like a language if its n-grams are at least LEAST_LIKE times as usual there as those of its training
#: texts; a short text may also be under that by chance, up to CHANCE times the training texts' spread (a median, so about a third
#: of what few n-grams vary by).
LEAST_LIKE, CHANCE = 0.4, 9.0


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return np.where(np.random.default_rng(20).integers(0, 2, (SYMBOLS, DIM)) == 1, 1, -1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams given as numbers in base SYMBOLS."""
    v = letter_vectors()
    out = np.ones((len(grams), DIM), np.int8)
    for k in range(N):
        out *= np.roll(v, k, axis=1)[grams // SYMBOLS**k % SYMBOLS]
    return out


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point up to U+FFFF: letters by their lower case."""
    table = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = code > 0xFFFF
    s = symbol_table()[np.where(high, 0, code)]
    if high.any():
        s[high] = [27 + int(c) % (SYMBOLS - 27) if chr(c).isalpha() else 0 for c in code[high]]
    return s


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts; none if it has no letter."""
    s = symbols(text)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]  # a run of non-letters is one symbol
    g = np.zeros(len(s) - N + 1, np.int64)
    for k in range(N):
        g += s[k : len(s) - N + 1 + k].astype(np.int64) * SYMBOLS**k
    if len(g) > 40_000:
        n = np.bincount(g, minlength=SYMBOLS**N)
        return np.flatnonzero(n), n[n > 0]
    return np.unique(g, return_counts=True)


def bundles(texts: list[str | None]) -> np.ndarray:
    """One vector a text; whole numbers, so that sums don't depend on their order: in float32 while they stay under 2**24, in float64 else."""
    found = [grams(t or "") for t in texts]
    kind = np.float32 if all(n.sum() < 1 << 24 for _, n in found) else np.float64
    every = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, np.int64)
    out = np.zeros((len(texts), DIM), np.float64)
    for at in range(0, len(every), 8192):
        part = every[at : at + 8192]
        count = np.zeros((len(texts), len(part)), kind)
        for i, (g, n) in enumerate(found):
            lo, hi = np.searchsorted(g, [part[0], part[-1] + 1])
            count[i, np.searchsorted(part, g[lo:hi])] = n[lo:hi]
        out += count @ gram_vectors(part).astype(kind)
    return out


def learnt_from(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int | None = None) -> DataFrame:
    """``l, t``: all rows with a text, an id and a language.

    ``fit_rows``, if given, says about how many of them instead; a hash of ``key`` and the numbers of rows by language say which.
    Every language then has an even share, and what small ones leave goes to the others, so a rare language isn't missed. One
    number a language comes to the driver. Nothing is sorted or shuffled but counts.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("k is not null and l is not null and t is not null")
    if fit_rows is None:
        return known.select("l", "t")
    counts = sorted((r["count"], r.l) for r in known.groupBy("l").count().collect())
    rates, left = [], float(fit_rows)
    for i, (n, language) in enumerate(counts):
        own = min(n, left / (len(counts) - i))
        rates.append((language, own / n))
        left -= own
    if not rates:
        return known.select("l", "t").limit(0)
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    rate = F.broadcast(docs.sparkSession.createDataFrame(rates, "l string, rate double"))  # one row a language
    return known.join(rate, "l").where(place < F.col("rate")).select("l", "t")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int | None = None) -> dict[str, np.ndarray]:
    """Prototypes by language, from the rows of learnt_from(): all that have a text, an id and a language. What comes to the
    driver is one vector a language: the counts are added on the executors.
    """
    known = learnt_from(docs, text, lang, key, fit_rows)

    def partial(lists):
        sums: dict[str, np.ndarray] = {}
        for rows in lists:
            if len(sums) >= FIT_LANGUAGES:
                yield [(k, [int(x) for x in v]) for k, v in sums.items()]
                sums = {}
            v = bundles([r[1] for r in rows])
            for x, r in zip(v, rows):
                norm = np.sqrt(x @ x)
                if norm:
                    sums[r[0]] = sums.get(r[0], 0) + np.rint(x * (2**20 / norm)).astype(np.int64)  # each text counts alike
        yield [(k, [int(x) for x in v]) for k, v in sums.items()]

    parts = map_rows(known, partial, "l string, v array<bigint>")
    total = parts.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x")).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.l: np.array([x.x for x in r.v], np.float64) for r in total.collect()}


def scorer(prototypes: dict[str, np.ndarray]):
    """A function from texts to (language, score) pairs."""
    names = sorted(prototypes)
    p = np.array([prototypes[k] / max(np.sqrt(prototypes[k] @ prototypes[k]), 1e-12) for k in names]).reshape(len(names), DIM)
    mean = p.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    p = p - mean
    p /= np.maximum(np.sqrt((p * p).sum(axis=1, keepdims=True)), 1e-12)

    def score(texts: list[str | None]) -> list[tuple[str, float]]:
        v = bundles(texts)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = v / np.maximum(norm, 1e-12) - mean
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        c = v @ p.T
        best = c.argmax(axis=1) if names else []
        return [(names[b], float(min(1.0, max(0.0, (1 + row[b]) / 2)))) if n else (UNDETERMINED, 0.0) for row, b, n in zip(c, best, norm.ravel())] if names else [(UNDETERMINED, 0.0)] * len(texts)

    return score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the cosine, moved from -1..1 to 0..1) for every row of ``docs``."""

    def run(lists):
        score = scorer(prototypes)
        for rows in lists:
            yield [(r[0], *x) for r, x in zip(rows, score([r[1] for r in rows]))]

    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, lang_pred string, score double")


def usual(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages (by name): how usual a text's n-grams are there on average, in any unit; and how many n-grams tell, repeated ones less."""
    p = np.array([prototypes[k] / max(np.sqrt(prototypes[k] @ prototypes[k]), 1e-12) for k in sorted(prototypes)]).reshape(len(prototypes), DIM)
    counts = [grams(t or "")[1].astype(float) for t in texts]
    n = np.array([c.sum() for c in counts])
    return bundles(texts) @ p.T / np.maximum(n, 1)[:, None], n * n / np.maximum([c @ c for c in counts], 1)


def norms(docs: DataFrame, prototypes: dict[str, np.ndarray], **names) -> dict[str, tuple[float, float]]:
    """By language, of the texts that ``fit`` learns from: the median of ``usual``, and the spread of one n-gram as a share of it.

    Both are exact medians over all those texts, so that some wrong labels don't move them. Two numbers a text are written to the
    shared folder; what comes to the driver doesn't grow with the texts (medians()).
    """
    at = {k: i for i, k in enumerate(sorted(prototypes))}

    def run(lists):
        for rows in lists:
            u, n = usual([r[1] for r in rows], prototypes)
            yield [(r[0], float(x[at[r[0]]]), float(m)) for r, x, m in zip(rows, u, n) if m and r[0] in at]

    each = written(map_rows(learnt_from(docs, **names), run, "l string, u double, n double"), "language-usual")
    middle = {k: m for k, m in medians(each, "l", "u").items() if m > 0}
    if not middle:
        return {}
    known = F.broadcast(each.sparkSession.createDataFrame(list(middle.items()), "l string, middle double"))  # one row a language
    spread = medians(each.join(known, "l").select("l", (F.abs(F.col("u") / F.col("middle") - 1) * F.sqrt("n")).alias("d")), "l", "d")
    return {k: (m, 1.4826 * spread[k]) for k, m in middle.items()}


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], norm: dict[str, tuple[float, float]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is like some language (LEAST_LIKE).

    A text too short to tell (by CHANCE, some dozens of n-grams) stays, one without letters goes.
    """
    own = {k: prototypes[k] for k in norm}
    middle, spread = np.array([norm[k] for k in sorted(norm)]).reshape(-1, 2).T

    def make():
        def keep(texts):
            u, n = usual(texts, own)
            least = np.minimum(LEAST_LIKE, 1 - CHANCE * spread / np.sqrt(np.maximum(n, 1))[:, None])
            return ((u / middle >= least).any(axis=1) & (n > 0)).tolist()

        return keep

    return filter_texts(docs, make, text)


def to_learn(docs: DataFrame) -> DataFrame:
    """The documents that aren't held out."""
    return docs.where(bucket(F.col("doc_id"), 4) != 2)


def trained(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the documents that aren't held out."""
    return fit(to_learn(docs))


def op8(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, with ``held_out`` (crc32 of the id's text mod 4 is 2; false for null ids)."""
    out = predict(docs, trained(docs))
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
