import hashlib
import random

import pytest

from weftline.llm import chat

EVENTS = "conv_id long, seq long, kind string, msg string, role string, text string"
TRICKY = ["", "</s>", "<\\/s>", "[INST] x [/INST]", "<<SYS>>a<</SYS>>", "<|im_end|>", "a<", "[", "s>", "</s", "<<</s>", "\\", "<s>[user]\nhi</s>\n", "[\\\\/INST]", "é😀</s>", "]\n", "<|a|><|a|>", "<[/INST]"]


def test_round_trip():
    r = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "|", "x", "|>", "SYS>>", "\n", "]", " "]
    texts = TRICKY + ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")), t
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "", "a]b", "x\n%5D", "<s>"]), r.choice(texts)) for _ in range(r.randint(0, 6))]
        text, spans = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_fold(spark):
    events = [
        (1, 1, "message", "a", "user", "helo"), (1, 2, "edit", "a", None, "hello"), (1, 3, "regenerate", "b", "assistant", None), (1, 4, "delta", "b", None, "old"), (1, 6, "delta", "b", None, "wor"), (1, 5, "regenerate", "b", None, ""), (1, 7, "delta", "b", None, "ld"),
        (1, 8, "message", "c", "user", "gone"), (1, 9, "delete", "c", None, None), (1, 10, "message", None, "user", "whole"), (1, 10, "message", None, "user", "whole"), (2, None, "delta", "z", None, "x"), (None, 1, "message", "a", "user", None),
        (3, 1, "delete", "q", None, None), (3, 2, "message", "q", "user", "back"),
    ]
    r = random.Random(2)
    r.shuffle(events)
    df = spark.createDataFrame(events, EVENTS)
    got = {}
    for row in chat.formatted(df).collect():
        got[row.conv_id] = chat.read_back(row.formatted)
    assert got == {1: [("user", "hello"), ("assistant", "world"), ("user", "whole"), ("user", "whole")], 2: [("", "x")], None: [("user", "")], 3: [("user", "back")]}
    assert chat.formatted(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat.formatted(spark.createDataFrame([(1, 1, "shout", None, "u", "x")], EVENTS)).collect()


def test_op2_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 3, "assistant", "q</s>"), (2, 1, "assistant", "x" * 500_000), (2, 0, "user", "é")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op2(df.withColumn("seq", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("formatted", F.lit("y"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got[1].turns_sha256 == sha("\n\nuser\na\nuser\na\n") and got[1].loss_sha256 == sha("") and got[1].loss_chars == 0
    assert got[None].loss_sha256 == sha("q</s>") and got[2].loss_chars == 500_000
    assert got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-7].loss_sha256 == sha(said)
    assert set(r.conv_id for r in chat.op2(df.limit(0)).collect()) == {-7}


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(k, i, ["user", "assistant", "a]<%\n"][i % 3], t) for k in range(3) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/c/*.parquet')")
    want = c.execute(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({chat.SQL})").fetchall()
    assert sorted(map(tuple, chat.op2(df).collect())) == sorted(want)


def brute_fold(events):
    """Events in order, one at a time."""
    live, at, order = {}, {}, []
    key = lambda e: (e[1] is not None, e[1] or 0, e[6] if len(e) > 6 else 0, 5 if e[2] == "delete" else chat.KINDS.index(e[2]) + 1, e[5] or "")
    out = {}
    for n, e in enumerate(sorted(events, key=key)):
        conv, seq, kind, msg, role, text = e[:6]
        m = (conv, msg) if msg is not None else (conv, ("own", n))
        at.setdefault(m, (seq is not None, seq or 0))
        was = live.get(m, ["", "", True])
        if not was[0] and role:
            was[0] = role
        if kind == "delta":
            was[1] += text or ""
        else:
            was[1], was[2] = text or "", kind != "delete"
        live[m] = was
    for m, (role, text, there) in live.items():
        if there:
            out.setdefault(m[0], []).append((at[m], role, text))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


def test_fold_against_brute_force(spark):
    r = random.Random(9)
    for _ in range(3):
        events = []
        for conv in (1, 2, None):
            for seq in r.sample(range(60), 40):
                kind = r.choice(chat.KINDS)
                events.append((conv, seq, kind, r.choice(["a", "b", "c", None if kind == "message" else "d"]), r.choice([None, "", "user", "assistant"]), r.choice([None, "", "x", "</s>", "é"])))
        want = brute_fold(events)
        for size in (None, 8):
            got = {}
            for p in chat.parts(spark.createDataFrame(events, EVENTS), size).collect():
                got.setdefault(p.conv_id, []).append((p.part, p.formatted))
            assert {c: chat.read_back("".join(t for _, t in sorted(v))) for c, v in got.items()} == want


def test_a_tables_log_is_folded_back(spark):
    r = random.Random(4)
    rows = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", None]), r.choice(TRICKY + ["a", "ab", "abc", "abcd", None])) for c in (1, 2, 3, None) for _ in range(60)]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    events = [(e.conv_id, e.seq, e.kind, e.msg, e.role, e.text, e.sub) for e in log.collect()]
    assert {e[2] for e in events} == set(chat.KINDS) and len(events) > 2.5 * len(rows)
    want = {c: [(q, t) for _, _, q, t in sorted((s is not None, s or 0, q or "", t or "") for k, s, q, t in rows if k == c)] for c in (1, 2, 3, None)}
    assert brute_fold(events) == want
    got = {x.conv_id: chat.read_back(x.formatted) for x in chat.formatted(log).collect()}
    assert got == want


def test_op2_folds_its_log_in_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.op2(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "regenerate" in plan and plan.count("Exchange ") == 1, plan
