import random

from weftline.llm import decontaminate as d


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s))
        if r.random() < 0.33:
            s[k] = r.choice("qxz")
        elif r.random() < 0.5:
            del s[k]
        else:
            s.insert(k, r.choice("qxz"))
    return "".join(s)


def test_myers_against_dynamic_programming():
    r = random.Random(2)
    for _ in range(400):
        p, t = ("".join(r.choices("abc", k=r.randint(lo, 90))) for lo in (1, 0))
        assert d.myers(p, t)[0] == brute(p, t)


def test_all_occurrences_within_budget(spark, docs, words):
    r = random.Random(4)
    items = [(i, words(r.randint(4, 30))) for i in range(12)]
    rows = []
    for k in range(60):
        i = r.randrange(12)
        t = d.normal(items[i][1])
        n = r.randint(0, d.budget(len(t)) + 4)
        rows.append((k, f"{words(20)} {edited(r, t, n)} {words(20)}"))
    out = d.matches(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.distance for x in out.collect()}
    want = {}
    for k, t in rows:
        for i, p in items:
            n = brute(d.normal(p), d.normal(t))
            if n <= d.budget(len(d.normal(p))):
                want[k, i] = n
    assert got == want and len(want) > 20
    split = d.matches(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    assert {(x.doc_id, x.item_id): x.distance for x in split.collect()} == want


def brute_holds(t, p):
    """Whether the normal text holds the normal item: edits in 8 % of its characters; with none to spare, as whole words."""
    e = len(p) * 8 // 100
    if e:
        return brute(p, t) <= e
    return f" {p} " in f" {t} "


def test_short_items_may_differ_too(spark, docs, words):
    r = random.Random(8)
    items = [(1, "capital of france is?"), (2, "abc def ghi j"), (3, "tiny one"), (4, "who was he"), (5, words(5)[:13].strip() + "xyzq")]
    rows = [(0, "the cbpital of france is? paris"), (1, "abc dxf ghi j"), (2, "abc dxf ghj j"), (3, "a tiny one."), (4, "a tiny one b"), (5, "whowas he"), (6, "xwho was he")]
    rows += [(10 + k, f"{words(3)} {edited(r, d.normal(items[k % 5][1]), k % 3)} {words(3)}") for k in range(60)]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, t in rows for i, p in items if brute_holds(d.normal(t), d.normal(p))}
    assert {(x.doc_id, x.item_id) for x in d.matches(docs(rows), df).collect()} == want
    assert {(0, 1), (1, 2), (4, 3)} <= want and not {(2, 2), (3, 3), (5, 4), (6, 4)} & want
    for chars in (10**6, 20):
        kept = d.clean(docs(rows + [(0, "a leak-free row"), (4, None)], extra=("row_k1", "k1")), df, block_chars=chars)
        assert sorted(x.doc_id for x in kept.collect()) == sorted([k for k, _ in rows if k not in {a for a, _ in want}] + [0, 4])


def test_edges(spark, docs):
    long = "a question about the long river and the bridge that crosses it"
    items = spark.createDataFrame([(1, long), (2, None), (3, "  "), (4, "short one"), (None, long), (1, long)], "item_id long, text string")
    rows = [(1, long.upper()), (2, None), (3, ""), (4, "ashort one"), (5, "a  Short\nONE b"), (None, "x " + long), (7, "w " * 300_000 + long), (1, long)]
    got = sorted((x.doc_id or 0, x.item_id or 0) for x in d.op10(docs(rows, extra=("item_id", "distance")), items).collect())
    assert got == sorted([(k, i) for k in (1, 1, 0, 7) for i in (1, 1, 0)] + [(5, 4)])
    kept = d.clean(docs(rows, extra=("item_id",)), items)
    assert sorted(x.doc_id for x in kept.collect()) == [2, 3, 4] and "item_id" in kept.columns
    assert d.op10(docs([]), items).count() == 0 and d.op10(docs(rows), items.limit(0)).count() == 0
