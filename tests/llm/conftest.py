import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (id, text[, lang]) tuples."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture
def words():
    """A seeded source of texts."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pool = ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(400)]
    return lambda n: " ".join(r.choices(pool, k=n))
