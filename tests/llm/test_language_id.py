import zlib

from weftline.llm import language_id

EN = "the cat and the dog went with that thing over there while she was thinking"
DE = "der hund und die katze gingen nicht mit einer schönen straße über das haus"


def rows(n=60):
    import random

    r = random.Random(1)
    return [(i, " ".join(r.choices((EN if i % 2 else DE).split(), k=30)), "en" if i % 2 else "de") for i in range(n)]


def test_held_out_accuracy_and_edges(spark, docs):
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !! 456", "en"), (None, EN, "en"), (1003, DE * 4000, None), (1003, DE * 4000, None)]
    out = language_id.op8(docs(rows() + extra, extra=("score", "lang_pred", "h", "k"))).collect()
    assert len(out) == 66 and out[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0.0
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_teach_nothing(docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    base = language_id.trained(docs(rows(40)))
    more = language_id.trained(docs([r for r in rows(40)] + [(h, EN, "xx") for h in held if h >= 40]))
    assert set(base) == set(more) == {"en", "de"} and all((base[k] == more[k]).all() for k in base)


def test_empty_and_unlabelled(docs):
    assert language_id.op8(docs([])).count() == 0
    assert language_id.op8(docs([(1, EN), (2, None)])).select("lang_pred").distinct().first()[0] == "und"


def test_bundles_are_the_sum_of_bound_letters():
    import numpy as np

    v = language_id.letter_vectors().astype(int)
    s = [0, *language_id.symbols("ab c"), 0]
    want = sum(np.roll(v[s[i]], 0) * np.roll(v[s[i + 1]], 1) * np.roll(v[s[i + 2]], 2) for i in range(len(s) - 2))
    assert (language_id.bundles(["ab c"])[0] == want).all()


def test_predictions_against_brute_force(docs):
    """Letters bound and bundled one n-gram at a time, cosines by the formula."""
    import numpy as np

    v = language_id.letter_vectors().astype(np.int64)

    def bundle(t):
        s = [0]
        for c in language_id.symbols(t).tolist() + [0]:
            if c or s[-1]:
                s.append(c)
        out = np.zeros(language_id.DIM)
        for i in range(len(s) - 2):
            out += v[s[i]] * np.roll(v[s[i + 1]], 1) * np.roll(v[s[i + 2]], 2)
        return out

    data = rows(40)
    learnt = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    unit = lambda x: x / np.sqrt(x @ x)
    proto = {k: unit(sum(unit(bundle(t)) for _, t, lang in learnt if lang == k)) for k in ("de", "en")}
    mean = (proto["de"] + proto["en"]) / 2
    for r in language_id.op8(docs(data)).collect():
        x = unit(unit(bundle(data[r.doc_id][1])) - mean)
        c = {k: float(x @ unit(p - mean)) for k, p in proto.items()}
        best = max(c, key=c.get)
        assert r.lang_pred == best and abs(r.score - (1 + c[best]) / 2) < 1e-5


def test_rare_languages_are_learnt(docs):
    many = [(i, EN, "en") for i in range(600)] + [(1000 + i, DE, "de") for i in range(6)]
    got = language_id.learnt_from(docs(many), fit_rows=60).groupBy("l").count().collect()
    got = {r.l: r["count"] for r in got}
    assert got["de"] == 6 and 30 < got["en"] < 85


def test_alphabets_beyond_latin_stay_apart():
    for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "áàâäãåéèêëíïóôöúüçñßæø"):
        assert len(set(language_id.symbols(letters).tolist())) > 0.8 * len(letters)


def test_long_texts_stay_exact():
    import numpy as np

    one = language_id.bundles(["ab "])[0]
    assert (language_id.bundles(["ab " * 6_000_000])[0] % 1 == 0).all() and one.dtype == np.float64


def test_prototypes_and_norms_come_from_all_rows(docs):
    import random

    import numpy as np

    r = random.Random(4)
    data = [(i, " ".join(r.choices((EN if i % 3 else DE).split(), k=r.randint(1, 5))), "en" if i % 3 else "de") for i in range(24_000)]
    d = docs(data)
    assert language_id.learnt_from(d).count() == len(data)
    proto = language_id.fit(d)
    got = language_id.norms(d, proto)
    assert set(got) == {"de", "en"}
    for at, k in enumerate(sorted(proto)):
        own = [t for _, t, lang in data if lang == k]
        vectors = np.concatenate([language_id.bundles(own[i : i + 500]) for i in range(0, len(own), 500)])
        assert (proto[k] == np.rint(vectors * (2**20 / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)))).sum(axis=0)).all()
        u, n = (np.concatenate(x) for x in zip(*(language_id.usual(own[i : i + 500], proto) for i in range(0, len(own), 500))))
        middle = np.median(u[:, at])
        want = middle, 1.4826 * np.median(np.abs(u[:, at] / middle - 1) * np.sqrt(n))
        assert np.allclose(got[k], want, rtol=1e-9)


def test_medians_are_exact(spark):
    import numpy as np

    from weftline.llm.common import medians

    r = np.random.default_rng(3)
    by = {"a": r.normal(size=801), "b": np.exp(r.normal(size=500) * 9), "c": np.repeat([1.0, 2.0], 50), "d": np.array([-7.0]), "e": np.array([1e308, -1e308, -3.0, 5e-324]), "f": np.array([0.1] * 9 + [5.0]), "g": np.array([3.0, 4.0]), "h": np.array([0.0, 5e-324] * 2 + [0.0])}
    rows = [(k, float(x)) for k, v in by.items() for x in v] + [("a", None), (None, 1.0), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: float(np.median(v)) for k, v in by.items()}
    for most, cells in ((10**6, 1 << 14), (0, 1 << 14), (0, 64), (700, 20)):
        assert medians(df, "k", "v", most, cells) == want
    assert medians(df.limit(0), "k", "v") == {}
