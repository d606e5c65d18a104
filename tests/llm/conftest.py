import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, lang, source) with columns whose names operators use inside or return."""
    def make(rows, **extra):
        rows = [(r + (None,) * 4)[:4] + (None if r[1] is None else len(r[1]),) for r in rows]
        df = spark.createDataFrame(rows, COLUMNS)
        from pyspark.sql import functions as F
        for n in ("id", "key", "b", "q", "node", "_rank", "_size", "shard", "score", "kept", "n"):
            df = df.withColumn(n, F.lit(7))
        return df
    return make


WORDS = "the house of a green river and an old bridge is by this quiet town where many people walk to their work with bread or milk".split()


def prose(seed, n):
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.6) for _ in range(n))


@pytest.fixture
def awkward():
    """Null and empty texts, null sources, ties, repeated rows, one very long text, white space of all kinds."""
    long = prose(1, 30_000)
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", "a"), (4, prose(2, 60), "en", "a"), (5, prose(2, 60), "en", None),
            (6, prose(2, 60) + " tail", "de", "b"), (7, long, "en", "a"), (8, long[:50_000] + " x " + long[50_000:], "en", "a"), (9, "one two three", "fr", ""),
            (10, "One  TWO\nthree", "fr", "b"), (11, "ŠĐ ünïcode “quotes” 漢字 \U0001f600 é", "xx", "b"), (12, "a" * 300, "en", "a"), (13, "a" * 300 + "b", "en", "a"),
            (None, prose(3, 40), None, "a"), (None, None, None, None), (14, prose(4, 40), "en", "a"), (14, prose(4, 40), "en", "a"), (-5, prose(5, 3), "de", "a")]
