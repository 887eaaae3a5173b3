import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau").split()) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, shared lines and passages."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    long = "\n".join(" ".join(words(rng, 12)) for _ in range(3000))
    base = " ".join(words(rng, 120))
    rows = [
        (1, None, "en", "a", 1),
        (2, "", None, "a", None),
        (3, "   \t \n ", "en", None, 3),
        (4, "One short line.", "en", "b", 4),
        (5, base, "en", "a", 5),
        (6, base, "en", "b", 6),
        (6, base, "en", "b", 6),
        (7, base.replace(" ", "\n", 3), "en", "b", 6),
        (8, long, "en", "c", 8),
        (9, "x" * 100_000, "en", "c", 8),
        (10, "Ünïcödé ▁ 漢字 \x00   text\r\nwith a shared line of thirty chars\n\n", "de", "c", 1),
        (11, "  With A SHARED line of thirty chars \nown line eleven", "de", "c", 1),
        (12, "with a shared line of thirty chars\nwith a shared line of thirty chars", "de", "c", 1),
        (None, "with a shared line of thirty chars\n" + passage, "de", None, None),
        (13, " ".join(words(rng, 20)) + " " + passage, "en", "a", 1),
        (14, passage + "\n" + " ".join(words(rng, 30)), "en", "a", 1),
        (15, " ".join(words(rng, 5)) + " " + passage + " " + passage, "en", "a", 1),
        (15, "another text with the same id as the one before it, not the same words", "en", "a", 1),
        (16, base + " tail", "en", "a", 1),
    ]
    for i in range(20, 60):
        rows.append((i, " ".join(words(rng, rng.randint(1, 80))), rng.choice(("en", "de")), rng.choice("abc"), i))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns that are named like what operators add."""
    from pyspark.sql import functions as F

    names = "kept keep_id group_size shard slot size law text_crc32 bucket batch piece n_tokens fingerprint component_id n_words ids n_lines pos part digest node label u v rank total".split()
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def rows_of():
    return collected
