from contextlib import contextmanager

import duckdb
import pytest

from tallywarden.llm.queries import vocabulary

WORDS = "the quick brown fox jumps over a lazy dog while seven grey birds watch from some old wall near our house".split()


def prose(seed, count):
    """Words that differ with the seed, so that two seeds share no shingle by chance."""
    return " ".join(f"{WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)]}{(seed * 31 + i) % 97}" for i in range(count))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, and names of their results.
CLASHES = "size long, copies long, key string, lang_pred string, score double, languages string, lines_removed long, value long, ids string, sketch long, virtual double, gone long, kept boolean, h long, id long, length long"


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(3, 60)
    return [
        (1, base, "en", "a", 7),
        (1, base, "en", "a", 7),
        (2, None, None, None, None),
        (None, prose(5, 40), "fr", "b", 3),
        (None, None, None, None, None),
        (3, "", "en", None, 0),
        (4, " \n\t\n ", None, "b", 4),
        (5, prose(11, 60_000), "de", "c", 9),
        (6, base + " extra", "en", "b", 9),
        (7, base, "en", "c", 9),
        (8, "Only three words", "en", "a", 1),
        (9, "only THREE words", "en", "a", 1),
        (10, "\n".join([prose(5, 40), "x", "two words", "more of them", "", prose(3, 60)]), "en", "b", 2),
        (11, "\n".join(["first of all", "x", "two words", "more of them", "", "the end"]), "en", "c", 2),
        (12, "12 %% -- 34", "en", "c", 2),
        (13, "é ñ <|endoftext|> ÀÉ. U.S.A., don't", "fr", "é", 2),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    plain = spark.createDataFrame(odd_rows, SCHEMA)
    clash = [f"cast(null as {c.split()[1]}) AS {c.split()[0]}" for c in CLASHES.split(", ")]
    return plain.selectExpr("*", *clash)


@pytest.fixture
def none(spark, odd):
    return odd.where("false")


@pytest.fixture
def little_sent(spark):
    """Let Spark send tables that it guesses to be below 10 MB, and fail if one proves larger than so many MB, as a small driver would."""

    @contextmanager
    def limit(mb):
        conf = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": str(int(mb * 2**20))}
        for key, value in conf.items():
            spark.conf.set(key, value)
        try:
            yield
        finally:
            for key in conf:
                spark.conf.unset(key)

    return limit


@pytest.fixture(scope="session")
def words():
    return vocabulary()


@pytest.fixture
def duck():
    """DuckDB with given rows as tables."""

    def connect(**tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        return con

    return connect
