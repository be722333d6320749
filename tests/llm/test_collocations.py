import random

import duckdb
import numpy as np
import pytest

from meshtide.llm import collocations as C
from meshtide.llm.shared import Scratch, documents

from .conftest import rows_of, same_rows

SF = "/root/testdata/sf0.001"


def sentences(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["New York city", "new york", "of the of", "the", "machine learning is fun", "x", "été à Paris"]) +
                   r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows(awkward):
    own = [(None if i % 4 == 0 else "und" if i % 4 == 1 else "en", sentences(i, 60)) for i in range(40)]
    return own + own[:3] + [("fr", None), (None, ""), ("fr", "..."), ("en", "word " * 3000), ("de", "nur zwei")] + [("xx", t) for _, t in awkward]


@pytest.fixture(scope="module")
def table(spark, rows):
    full = [(i, t, lang, "a", 1, None) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, phrase string, n long, chunk binary").repartition(5)


@pytest.mark.parametrize("least, top", [(20, 2000), (5, 7)])
def test_phrases_against_one_dictionary(table, rows, least, top):
    same_rows(C.collocations(table, least, top), C.brute_force(rows, least, top))


def test_small_blocks_short_chunks_and_full_filters_change_nothing(table, rows, monkeypatch):
    for name, value in {"HELD_BYTES": 2000, "HELD_ROWS": 100, "TRIGGER": 3}.items():
        monkeypatch.setattr(C, name, value)
    monkeypatch.setattr("meshtide.llm.bloom.PROBES", 1)
    same_rows(C.collocations(table, 10, max_filter_mb=1), C.brute_force(rows, 10))


def test_every_phrase_of_the_dictionary_counts_once(spark, table, rows):
    """The parse alone, without filters: frequencies of owned phrases are those of the texts."""
    with Scratch(spark) as scratch:
        chunks = C.parsed(table, scratch).collect()
    assert len(chunks) == len({(r.lang, r.last, bytes(r.chunk)) for r in chunks})
    found: dict = {}
    for r in chunks:
        own = np.frombuffer(bytes(r.chunk) + b"\n", np.uint8)
        x = C.Block([r.lang], np.array([r.last]), np.array([r.n]), own, np.array([len(own) - 1]))
        for k in range(1, 6):
            for s in x.places(k, x.tied).tolist():
                phrase = b" ".join(bytes(r.chunk)[x.first[s]:x.past[s + k - 1]].split())
                found[r.lang, phrase] = found.get((r.lang, phrase), 0) + r.n
    n_by = {(lang, p): a for lang, _, p, a, *_ in C.brute_force(rows, 2, 10**9)}
    assert all(found[lang, p.encode()] == a for (lang, p), a in n_by.items()) and n_by


def test_no_rows(table):
    assert rows_of(C.collocations(table.where("false"))) == []
    assert rows_of(C.collocations(table.where("lang = 'fr'"), 1)) == []


def test_wide_products_are_exact(spark):
    assert spark.sql("select cast(9000000000000000000 as decimal(19,0)) * cast(8000000000000000000 as decimal(19,0)) div "
                     "(cast(9000000000000000000 as decimal(19,0)) * cast(3 as decimal(19,0)))").first()[0] == 8 * 10**18 // 3


def test_given_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = C.collocations(documents(spark, SF))
    wanted = [tuple(r) for r in con.sql(f"SELECT {', '.join(found.columns)} FROM ({C.SQL})").fetchall()]
    assert wanted
    same_rows(found, wanted)
