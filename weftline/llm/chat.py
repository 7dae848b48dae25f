"""Chat formatting by event-sourced reconstruction.

A log has events (conversation, sequence, kind, message, role, text). Kinds: ``message`` opens a
message or sets its text, ``edit`` replaces it, ``regenerate`` clears it for the deltas to come (its own
text, if any, is their beginning), ``delta`` appends, ``delete`` removes the message until it is set again. Events are
partitioned by conversation and message, sorted by sequence (ties: the column ``sub``, if there is one, then kind in the
order above but delete last, then text), and folded; a conversation's messages follow in the order of their first
events (ties: role, text). A ``message`` event with a null message id is a message of its own.

The rendered text of a turn is ``<s>[role]`` newline, text, ``</s>`` newline. Control strings inside
texts get a backslash after their first character, and those that have backslashes there get one
more, so a reader can undo it and never meets a control string in a text. Loss spans are the
assistant's texts, as code points of the rendered text.

Rendering and reading back stream over the turns of a conversation in order, in parts of whole turns, so that a
task holds one message and one part, not a conversation; sorting may spill. formatted() joins the parts of a conversation.

A table of final turns has no log, so conversation_events() makes one that leads to it: every turn is opened, streamed,
edited, regenerated or deleted and set again, and its text comes out of the fold.

Null texts and roles count as empty; null conversation ids are one conversation of their own; null
sequences come first; repeated events are folded each. Unknown kinds raise an error. No events give no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import map_rows

#: Characters of a rendered part, from which the next turn starts another.
PART_CHARS = 1_000_000
KINDS = ("message", "edit", "regenerate", "delta", "delete")
_REST = r"/?s>|\|[^|<>\[\]\x00-\x20]{1,40}\|>|</?SYS>>|/?INST\]"
CONTROL = re.compile(rf"([<\[])(\\*)({_REST})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")
TURN = re.compile(r"<s>\[([^\]\n]*)\]\n(.*?)</s>\n", re.S)
_ROLE = {"%": "%25", "]": "%5D", "\n": "%0A", "<": "%3C"}


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text of (role, text) turns, and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"<s>[{''.join(_ROLE.get(c, c) for c in role)}]\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(parts), spans


def read_back(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered text; raises if it isn't one."""
    turns, at = [], 0
    for m in TURN.finditer(rendered):
        if m.start() != at:
            break
        role = m[1]
        for c, e in reversed(_ROLE.items()):
            role = role.replace(e, c)
        turns.append((role, unescape(m[2])))
        at = m.end()
    if at != len(rendered):
        raise ValueError("not a rendered conversation")
    return turns


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, at`` (the first event's sequence), ``role, text``, deleted ones left out.

    Events that are partitioned by conversation already aren't shuffled again; others are by conversation and
    message, so that a large conversation is spread.
    """
    sub = F.col("sub").cast("int") if "sub" in events.columns else F.lit(0)
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), known)
    e = events.select("conv_id", "seq", sub.alias("sub"), "kind", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rank", rank)
    own = F.when((F.col("kind") == "message") & F.col("msg").isNull(), F.struct("seq", "sub", "role", "text"))  # alike ones are counted
    log = e.withColumn("own", own).groupBy("conv_id", "msg", "own").agg(F.min("seq").alias("at"), F.array_sort(F.collect_list(F.struct("seq", "sub", "rank", "text", "role"))).alias("log"))
    reset = F.array_max(F.filter(F.transform("log", lambda x, i: F.when(x["rank"].isin(1, 2, 3, 5), i)), lambda i: i.isNotNull()))  # the last event that sets the text
    live = log.withColumn("from", F.coalesce(reset, F.lit(0))).where(F.get("log", F.col("from"))["rank"] != 5)
    texts = F.transform(F.slice("log", F.col("from") + 1, F.size("log")), lambda x: x["text"])
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != "")
    times = F.when(F.col("own").isNull(), 1).otherwise(F.size("log"))
    out = live.select("conv_id", "at", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), F.array_join(texts, "").alias("text"), times.alias("times"))
    return out.select("conv_id", "at", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def parts(events: DataFrame, part_chars: int | None = PART_CHARS) -> DataFrame:
    """``conv_id, part, formatted, loss_spans``: rendered conversations, cut between turns (None: never), in order within a task."""
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    turns = fold(events).withColumn("n", F.row_number().over(order)).select("conv_id", "text", "role", "n")

    def run(lists):
        conv, turns, size, part = None, [], 0, 0

        def made():
            text, spans = render(turns)
            return conv, part, text, [{"start": a, "end": b} for a, b in spans]

        for rows in lists:
            out = []
            for c, text, role, n in rows:
                if turns and (n == 1 or part_chars is not None and size >= part_chars):
                    out.append(made())
                    turns, size, part = [], 0, part + 1
                if n == 1:
                    part = 0
                conv = c
                turns.append((role, text))
                size += len(text)
            yield out
        if turns:
            yield [made()]

    return map_rows(turns, run, "conv_id long, part int, formatted string, loss_spans array<struct<start:long,end:long>>")


def formatted(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation that has a message left, whole (2 GB at most, as any string)."""
    return parts(events, None).drop("part")


def digests(out: DataFrame) -> DataFrame:
    """What can be read back from parts(), which must be in order within a task: counts and hashes of turns and of the text under the loss mask."""

    def run(lists):
        conv, state, began = None, None, False

        def done():
            n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for rows in lists:
            got = []
            for c, text, part, spans in rows:
                if part == 0:
                    if began:
                        got.append(done())
                    conv, state, began = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield got
        if began:
            yield [done()]

    return map_rows(out.select("conv_id", "formatted", "part", "loss_spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log whose fold they are: ``conv_id, seq, sub, kind, msg, role, text``.

    A turn's place in its conversation is its message's id, so repeated turns are messages of their own. By a hash of
    ids, a message is streamed; a draft that is edited; a draft that is regenerated and streamed; or one deleted and set again.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = own.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "role", "text")).cast("string"))
    size = F.length("text")
    one, two = F.floor(size / 3).cast("int"), F.floor(2 * size / 3).cast("int")
    whole, head, middle, rest, tail = F.col("text"), F.substring("text", F.lit(1), one), F.substring("text", one + 1, two - one), F.substring("text", one + 1, size), F.substring("text", two + 1, size)
    role, none = F.col("role"), F.lit("")

    def log(*events):
        return F.array(*(F.struct(F.lit(kind).alias("kind"), who.alias("role"), text.alias("text")) for kind, who, text in events))

    way = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(4))
    made = (
        F.when(way == 0, log(("message", role, head), ("delta", none, middle), ("delta", none, tail)))
        .when(way == 1, log(("message", role, F.lit("draft")), ("edit", none, whole)))
        .when(way == 2, log(("message", role, F.lit("draft")), ("delta", none, F.lit(" to go")), ("regenerate", none, head), ("delta", none, middle), ("delta", none, tail)))
        .otherwise(log(("message", role, F.lit("draft")), ("delete", none, none), ("message", none, head), ("delta", none, rest)))
    )
    return placed.select("conv_id", "seq", "msg", F.posexplode(made).alias("sub", "e")).select("conv_id", "seq", "sub", "e.kind", "msg", "e.role", "e.text")


def op2(conversations: DataFrame) -> DataFrame:
    """All conversations, and conversation -7, which holds control strings."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    names = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    return digests(parts(conversation_events(conversations.select(*names).unionByName(more))))


_DUCK = r"([<\[])(\\*)(/?s>|\|[^|<>\[\]\x00-\x20]{1,40}\|>|</?SYS>>|/?INST\])"
SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(11 + length(role) + 2 * (length(role) - length(translate(role, '%]<' || chr(10), ''))) + length(regexp_replace(text, '{_DUCK}', '\1\\\2\3', 'g')))::bigint as formatted_chars
from t group by conv_id
"""
