"""Small tables with the odd cases that every operator must handle."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(1, 4000)
    shared = prose(2, 40)
    return [
        (1, "one two three", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "one two three", "en", "b"), (5, long_text, "en", "a"),
        (6, long_text + " end", "en", "b"), (7, "start " + shared + " stop", "de", "a"), (8, shared, "de", "a"), (8, shared, "de", "a"),
        (None, shared, "de", None), (None, None, None, None), (9, "  \n\t ", "en", "c"), (10, "Ünïcödé 漢字 🙂 " + shared, "fr", "c"), (-5, "ONE two three", "en", "a"),
        (11, "aaaa" * 500, "en", "a"), (12, "aaaa" * 400, "en", "a"),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
