import pytest

#: Rows that every document operator must take: nulls in any column, empty, blank and very long texts, ties, repeats.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    long = prose(1, 30_000)
    a = prose(2, 200)
    near = a.replace(a.split()[100], "other", 1)
    rows = [
        (1, None, "en", "s1", None), (2, "", None, "s1", 0), (3, " \t\n ", "en", None, 3), (4, "one", "en", "s1", 3), (5, "ONE", "en", "s2", 3), (6, "a b c d", "en", "s2", 7),
        (7, a, "en", "s2", 9), (8, near, "en", "s3", 9), (9, a.upper(), "en", "", 9), (10, long, "en", "s1", 9), (11, long + " tail", "en", "s2", 9), (7, a, "en", "s2", 9), (None, a, "en", "s1", 9),
        (12, "éÉ \U0001f600  x \x00 y", "fr", "s3", 9), (13, prose(3, 60), "en", "s3", 9), (14, "x" * 100_000, "en", "s1", 9), (15, prose(4, 6), "en", "s2", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Extra columns named as operators name their own.
    from pyspark.sql import functions as F

    extra = ("size", "key", "id", "spans", "row", "d", "h", "toxicity", "n_units", "bucket_len", "component_id", "kept", "digest", "__text", "piece", "count", "w")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})
