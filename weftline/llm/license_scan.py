"""License scans by ordered signature rules, in DataFrame functions only.

One regex gates a document; in those that pass, the rules' keywords are looked for, and only the rules
whose keyword is there are run over the whole text. Where detections overlap, one that lies inside
another is suppressed, and of two that overlap otherwise the rule with the higher priority stays; only
detections that stay suppress others (resolved()). All of it is work within a row: no shuffle, and nothing kept across rows.

Fixed phrases are found besides, by words: runs of characters other than \\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F
after A-Z were lower-cased. Null and empty texts have no words and no detections. Null ids pass
through, repeated rows are scanned each.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.license_rules import GATE, rules

#: What lies between words in a text whose A-Z aren't lower-cased yet.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DETECTION = "struct<start:int,end:int,priority:int,label:string,weight:double>"


def word_count(text):
    """The number of words: parts between breaks, without the empty ones, which only the first and last can be. Extracting every word by a regex takes far longer."""

    def full(parts):
        first, last = F.element_at(parts, 1) == "", (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
        return (F.size(parts) - first.cast("int") - last.cast("int")).cast("long")

    return F.element_at(F.transform(F.array(F.split(text, f"{BREAK}+", -1)), full), 1)


def phrase_hits(text):
    """Array of (word index, label) for all places of the fixed phrases; null for a text that can't hold one."""
    pairs = {(p.split()[0], p.split()[1]) for p in PHRASES}
    gate = "(?:" + "|".join(sorted(f"{a}{BREAK}+{b}" for a, b in pairs)) + ")"
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), f"{BREAK}+"), lambda w: w != "")
    firsts = sorted({p.split()[0] for p in PHRASES})

    def found(words):
        starts = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(firsts))


        def places(phrase: str, label: str):
            here = F.filter(starts, lambda s: _all([F.get(words, s["i"] + k) == w for k, w in enumerate(phrase.split())]))
            return F.transform(here, lambda s: F.struct(s["i"].alias("i"), F.lit(label).alias("label")))

        return F.flatten(F.array(*(places(p, label) for p, label in PHRASES.items())))

    return F.when(text.rlike("(?i)" + gate), F.element_at(F.transform(F.array(words), found), 1))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def detections(text):
    """All places of all rules whose keyword is in the text: array of detections, null for gated texts."""
    table = rules()
    schema = "array<struct<label:string,priority:int,keyword:string,regex:string,weight:double>>"
    every = F.from_json(F.lit(json.dumps(table)), schema)

    def places(r):
        between, inside = F.split(text, r["regex"], -1), F.regexp_extract_all(text, r["regex"], F.lit(0))
        sizes = F.zip_with(F.transform(between, lambda x: F.length(x)), F.transform(inside, lambda x: F.length(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("out"))

        def step(acc, s):
            start = acc["at"] + s["a"]
            d = F.struct(start.alias("start"), (start + s["b"]).alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))
            return F.struct((start + s["b"]).alias("at"), F.concat(acc["out"], F.array(d)).alias("out"))

        return F.aggregate(F.filter(sizes, lambda s: s["a"].isNotNull() & s["b"].isNotNull()), empty, step, lambda acc: acc["out"])

    def run(there):
        return F.flatten(F.transform(F.filter(every, lambda r: F.array_contains(there, r["keyword"])), places))

    low = F.lower(text)
    there = F.filter(F.lit(sorted({r["keyword"] for r in table})), lambda k: F.contains(low, k))
    return F.when(text.rlike(GATE), F.element_at(F.transform(F.array(there), run), 1))


def resolved(found):
    """Detections left after suppression, by start.

    Again and again, of the detections that lie inside no other one left, that of the first rule is kept (ties: the first
    place), and all that it overlaps go. So whatever goes overlaps one that stays, and one that only a dropped detection hid is
    back. Done by groups of detections that overlap in a row.
    """
    one = lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("low"), d["priority"].alias("priority"), d["end"].alias("end"), d["label"].alias("label"), d["weight"].alias("weight"))
    kind = "struct<start:int,low:int,priority:int,end:int,label:string,weight:double>"
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = F.struct(lists.alias("groups"), none.alias("now"), F.lit(0).alias("end"))

    def group(acc, d):
        joins = (F.size(acc["now"]) == 0) | (d["start"] < acc["end"])
        return F.struct(
            F.when(joins, acc["groups"]).otherwise(F.concat(acc["groups"], F.array(acc["now"]))).alias("groups"),
            F.when(joins, F.concat(acc["now"], F.array(d))).otherwise(F.array(d)).alias("now"),
            F.when(joins, F.greatest(acc["end"], d["end"])).otherwise(d["end"]).alias("end"),
        )

    def settle(members):
        def inside(d, o):
            same = (o["start"] == d["start"]) & (o["end"] == d["end"])
            return F.when(same, o["priority"] < d["priority"]).otherwise((o["start"] <= d["start"]) & (o["end"] >= d["end"]))

        def step(acc, _):
            outer = F.filter(acc["left"], lambda d: ~F.exists(acc["left"], lambda o: inside(d, o)))
            best = F.array_min(F.transform(outer, lambda d: F.struct(d["priority"].alias("p"), d["start"].alias("s"), d.alias("d"))))["d"]
            kept = F.struct(
                F.filter(acc["left"], lambda o: (o["start"] >= best["end"]) | (o["end"] <= best["start"])).alias("left"),
                F.concat(acc["kept"], F.array(best)).alias("kept"),
            )
            return F.when(F.size(acc["left"]) == 0, acc).otherwise(kept)

        return F.when(F.size(members) < 2, members).otherwise(F.aggregate(members, F.struct(members.alias("left"), none.alias("kept")), step, lambda acc: acc["kept"]))

    grouped = F.aggregate(F.array_sort(F.transform(found, one)), start, group, lambda acc: F.concat(acc["groups"], F.array(acc["now"])))
    kept = F.array_sort(F.flatten(F.transform(grouped, settle)))
    return F.transform(kept, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight")))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, hits`` (phrase places) and ``detections`` (start, end, priority, label, weight) of every row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.select(
        "doc_id", F.coalesce(word_count(t), F.lit(0).cast("long")).alias("n_words"), F.coalesce(phrase_hits(t), F.array().cast("array<struct<i:int,label:string>>")).alias("hits"),
        F.coalesce(resolved(detections(t)), F.array().cast(f"array<{_DETECTION}>")).alias("detections"),
    )


def op5(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.transform("hits", lambda h: h["label"])
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.transform("hits", lambda h: h["i"].cast("long"))
    weight = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("hits") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"), weight.alias("score"),
    )
