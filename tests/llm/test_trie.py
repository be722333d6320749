import duckdb
import numpy as np
import pytest

from .conftest import rows_of, same_rows
from meshtide.llm import conversation_trie as T

SF = "/root/testdata/sf0.001"


def turns(c, *texts, start=0):
    return [(c, start + i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


AWKWARD = [
    *turns(100, "héllo", "yes", "more", "a", "b", "c", "d"), *turns(101, "x", "y"), *turns(102, "héllo", "yes", "more", "z", "w", "q"),
    *turns(103, *["same"] * 9), *turns(104, *["same"] * 9), *turns(199, "last"), *turns(7, "no family", "", "t" * 100_000),
    (8, None, None, None), (8, 0, "user", "after null"), (8, 1, None, "x"), (8, 1, "user", None), (9, 2, "user", "tie"), (9, 2, "user", "tie"),
    (9, 2, "assistant", "tie"), (None, 0, "user", "no conversation"), (-5, 0, "user", "negative"), (-105, 0, "user", "negative"), (-100, 0, "user", "base"),
    *[row for c in range(200, 260) for row in turns(c, "common", "common too", f"own {c % 7}", "end")],
    *[row for c in range(300, 310) for row in turns(c, *map(str, range(40)), str(c % 3))],
]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(*r, "z", None, i) for i, r in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, names string, key binary, n int").repartition(3)


@pytest.mark.parametrize("limit", [1, 3, 8192])
def test_nodes_against_plain_dictionaries(conversations, limit):
    same_rows(T.trie(conversations, limit), T.brute_force(AWKWARD))


def test_empty_table(conversations):
    assert rows_of(T.trie(conversations.where("false"))) == []
    assert rows_of(T.trie(conversations.where("conv_id is null"))) == []


def test_small_chunks_and_tasks_change_nothing(conversations, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 40)
    monkeypatch.setattr(T, "SHARD_TURNS", 10)
    same_rows(T.trie(conversations, 2), T.brute_force(AWKWARD))


def test_given_table_against_dictionaries_and_sql(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    found = T.trie(conversations)
    same_rows(found, T.brute_force([(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    same_rows(found, [tuple(r) for r in con.sql(f"SELECT {', '.join(found.columns)} FROM ({T.SQL})").fetchall()])


def test_double_array_holds_its_sequences_and_no_others():
    random = np.random.default_rng(3)
    seqs = [random.integers(0, 50, random.integers(0, 12)) for _ in range(400)]
    sizes = np.array([len(s) for s in seqs])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(seqs)
    trie = T.packed(flat, starts, sizes)
    prefixes = {tuple(s[:d].tolist()) for s in seqs for d in range(len(s) + 1)}
    assert (trie.check[:trie.top] >= 0).sum() == len(prefixes)

    def holds(seq):
        at = np.zeros(1, np.int64)
        for c in seq:
            at = trie.step(at, np.array([c]))
            if at[0] < 0:
                return False
        return True

    assert all(holds(p) for p in prefixes)
    others = [tuple(random.integers(0, 50, random.integers(1, 5)).tolist()) for _ in range(300)]
    assert [holds(o) for o in others] == [o in prefixes for o in others]
