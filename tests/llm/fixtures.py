"""Small tables with awkward rows, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    long = prose(20_000, 2)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(near), "en", None, 1),
        (4, None, None, None, None),
        (5, "", "de", "b", 0),
        (6, " \t\n ", None, "b", 3),
        (7, long, "en", "b", 1),
        (8, long[: len(long) // 2] + " tail é 日本 😀", "en", "c", 1),
        (9, "one two", "de", "c", 1),
        (10, "ONE Two", "de", "c", 1),
        (None, prose(30, 3), "de", "a", 1),
        (11, prose(8, 4) + "\n" + "same line\n" * 5, "en", "a", 1),
        (12, "ein kurzer Text mit Umlauten: äöü ß", "de", "b", 1),
        (13, "x" * 500, "en", "a", 1),
    ]
    return rows


def table(spark, rows):
    """The rows, with extra columns whose names clash with those inside the operators."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, SCHEMA)
    for c in ("n", "size", "key", "node", "root", "class", "pos", "host", "kept", "ids"):
        out = out.withColumn(c, F.lit(c))
    return out
