"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, node string, rank int, size int"


def prose(rng: random.Random, n: int) -> str:
    words = "the of and to in thnter onere stand with bling ouent erish thore wance plined grast".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "ly", "s"]) for _ in range(n))


def awkward(spark, repeat: bool = True):
    """Documents with null and empty texts, null ids, null columns, a very long text, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 90)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), "n", 1, 2) for i in range(40)]
    rows += [(40, None, None, None, None, None, None), (41, "", "en", "a", None, None, None), (42, " \t\n ", "en", "a", None, None, None), (None, prose(rng, 30), "en", "b", None, None, None), (43, prose(rng, 40_000), "en", "a", "n", 1, 2), (44, "1234 5678 !!", "en", "a", "n", 1, 2), (45, "été <|endoftext|> \U0001f600 x", "fr", "c", "n", 1, 2)]
    if repeat:
        rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
