import random

import pytest


def prose(seed: int, n: int, words=("the", "of", "ré", "x1", "lo,", "na.", "It's", "über")) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, near copies, odd spaces."""
    long = prose(1, 12_000)
    base = prose(2, 300)
    near = base.split(" ")
    near[150] = "changed"
    shared = prose(3, 120)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, base), (6, base), (7, " ".join(near)), (7, "other text of the same id"),
        (8, shared + " " + prose(4, 50)), (9, prose(5, 60) + "\n" + shared), (10, shared), (10, shared), (None, shared + "\ntail"),
        (11, "a line that many documents hold\nown " + prose(6, 9)), (12, "A LINE that many documents hold \nown two\n\n"),
        (13, "\va line that many documents hold\r\nlast\x1c"), (14, "a line that many documents hold"), (15, "€" * 30_000),
        (16, "漢字かな😀 ñandú fin <|endoftext|>"), (17, "word " * 500), (18, "a\x00b c"), (19, long[100:9000]),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The awkward rows as a table with extra columns named as the operators' own."""
    full = [(d, t, None if i % 3 else "en", None if i % 5 == 0 else f"src{i % 4}", None, i, "z", 0.5, i, "s", None)
            for i, (d, t) in enumerate(awkward)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, "
                                       "score double, n_lines int, size string, _row string").repartition(4)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_rows(df, expected):
    assert rows_of(df) == sorted(expected, key=str)
