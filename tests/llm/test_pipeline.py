import corpus_pipeline as c
from weftline.llm import decontaminate, packing, secrets, simhash


def test_stages_and_run(spark, tmp_path, docs, words):
    en = "the cat and the dog went with that thing over there while she was thinking of them".split()
    import random

    r = random.Random(8)
    text = lambda n: " ".join(r.choices(en, k=n)) + " " + " ".join("".join(r.choices("theandofing", k=6)) for _ in range(60))
    item = " ".join("".join(r.choices("theandofing", k=7)) for _ in range(30))
    base = [text(200) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(50, base[3], "en"), (51, text(80) + " " + item + " " + text(80), "en"), (52, "1234 ### 5678", "en"), (53, text(90) + " password=abcdef0123456789 " + text(9), "en"), (54, None, "en"), (None, text(50), "en")]
    (tmp_path / "x").mkdir()
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(rows)
    kept = []
    for name, stage in c.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs([]).columns, name
        d = spark.createDataFrame(d.collect(), d.schema)
        kept.append({x.doc_id for x in d.collect()})
    whole = {r[0] for r in rows}
    assert kept[0] == whole - {52, 54}
    assert kept[1] == kept[0] - {50}
    assert kept[2] == kept[1] - {51} and kept[3] == kept[2]
    assert "[SECRET]" in d.where("doc_id = 53").first().text
    out = c.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == kept[3]
    e = packing.encoder()
    assert sum(x.length for x in out) == sum(len(e(x.text)) // 2 + 1 for x in d.collect())
    assert decontaminate and secrets and simhash


def test_language_stage_rejects_what_is_like_no_language(spark, docs):
    import random

    r = random.Random(3)
    en = "the cat and the dog went with that thing over there while she was thinking of them".split()
    de = "der hund und die katze gingen nicht mit einer schönen straße über das haus als wir schliefen".split()
    rows = [(i, " ".join(r.choices(en if i % 2 else de, k=r.choice((4, 12, 40, 200)))), "en" if i % 2 else "de") for i in range(200)]
    bad = {
        1000: "".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=900)), 1001: "".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=200)),
        1002: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        1003: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        1004: "static int f(char *buf, size_t n) { for (size_t i = 0; i < n; ++i) if (!buf[i]) return -1; printf(\"%zu\", n); } #define MAXQ(x, y) ((x) > (y) ? (x) : (y))", 1005: "123 ### 4", 1006: None,
    }
    short = {2000: "the cat", 2001: "der hund", 2002: "that thing " * 300}
    out = c.language(spark, docs(rows + [(i, t, None) for i, t in {**bad, **short}.items()]), "").collect()
    assert {x.doc_id for x in out} == {i for i, *_ in rows} | set(short)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_that_share_an_id_are_told_apart(spark, docs, words):
    t, other, third = words(60), words(60), words(60)
    assert kept(c.near_duplicates(spark, docs([(0, t), (5, t), (5, other)]), "")) == sorted([(0, t), (5, other)])
    assert kept(c.near_duplicates(spark, docs([(1, t), (1, other), (2, third)]), "")) == sorted([(1, t), (1, other), (2, third)], key=repr)
    d = docs([(0, t), (5, other), (5, other), (None, t), (None, third), (None, third), (7, None), (8, ""), (9, None)], extra=("__rest", "k1", "row_k1", "fp", "root", "component_id", "stays"))
    out = c.near_duplicates(spark, d, "")
    assert out.columns == d.columns and kept(out) == sorted([(0, t), (5, other), (None, third), (7, None)], key=repr)
    from weftline.llm import common

    old = common.BROADCAST_ROWS
    try:
        common.BROADCAST_ROWS = 0
        assert kept(c.near_duplicates(spark, d, "")) == kept(out)
    finally:
        common.BROADCAST_ROWS = old


def test_near_duplicates_against_brute_force(spark, docs, words):
    import random

    from tests.llm.test_simhash import brute_components, brute_fingerprint

    r = random.Random(2)
    base, rows = [words(r.choice((1, 5, 80, 300))) for _ in range(25)], []
    for _ in range(120):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(len(w))] = "zz"
        rows.append((r.choice([None, *range(60)]), " ".join(w)))
    rows += [(3, None), (4, ""), (3, None)]
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    root = brute_components(list(enumerate(fps)))
    whole = {}
    for i, t in rows:
        whole.setdefault(root[fps.index(brute_fingerprint(t))], []).append((i, t))
    got = kept(c.near_duplicates(spark, docs(rows), ""))
    assert len(got) == len(whole) < len(rows)
    for i, t in got:
        group = whole.pop(root[fps.index(brute_fingerprint(t))])
        assert (i, t) in group and (i is None, i or 0) == min((k is None, k or 0) for k, _ in group)


def test_joins_of_hot_keys(spark):
    from weftline.llm.common import join_hot
    from weftline.llm.graph import components

    big = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as k")
    small = big.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, big.join(small, ["k"]).collect()))
    for hot in (1, 100, 10**6):
        assert sorted(map(tuple, join_hot(big, small, ["k"], "n", None, hot).collect())) == want
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(50)] + [(None, 3), (5, 5), (2000, 2001), (399, 3000)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, components(df).collect()))
    assert sorted(map(tuple, components(df, hot=20).collect())) == one and (3000, 0) in one and (1050, 1000) in one and len(one) == 400 + 51 + 2 + 1


def test_empty_table_and_clashing_columns(spark, docs, words):
    none = docs([])
    spark_bench = spark.createDataFrame([(1, words(12))], "item_id long, text string")
    import tempfile

    with tempfile.TemporaryDirectory() as f:
        spark_bench.write.parquet(f"{f}/benchmark.parquet")
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, none, f)
            assert out.columns == none.columns and out.count() == 0
        assert c.STAGES[-1][1](spark, none, f).count() == 0
        en = "the cat and the dog went with that thing over there while she was thinking of them".split()
        d = docs([(1, " ".join(en)), (1, " ".join(en)), (None, None), (2, "password=abcdefghijkl " + " ".join(en[::-1]))], extra=("shard", "ids", "item_id", "k2", "spans", "topic", "l"))
        for name, stage in c.STAGES[1:-1]:
            d = stage(spark, d, f)
            assert "clash" in {r.topic for r in d.collect()}, name
        assert sum(r.length for r in c.STAGES[-1][1](spark, d, f).collect()) > 0 and d.count() == 3
        assert {r.text for r in d.where("doc_id = 2").collect()} == {"[SECRET] " + " ".join(en[::-1])}
