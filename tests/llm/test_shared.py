import os

import pytest

from meshtide.llm import line_dedup, shared
from meshtide.llm.shared import Scratch, skewed_join


def folders(spark):
    where = shared.shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(where) if f.startswith("llm-")} if os.path.isdir(where) else set()


def test_tables_are_dropped(spark, docs):
    shared.release()
    before = folders(spark)
    with Scratch(spark) as scratch:
        a, b = scratch.cut(spark.range(5)), scratch.cut(spark.range(7), few=True)
        scratch.drop(a)
        scratch.keep(b)
        scratch.cut(spark.range(3))
    assert len(folders(spark) - before) == 1 and b.count() == 7
    with pytest.raises(RuntimeError), Scratch(spark) as scratch:
        scratch.cut(spark.range(5))
        raise RuntimeError
    shared.release()
    assert folders(spark) == before
    line_dedup.digests(docs).collect()
    shared.release()
    assert folders(spark) == before


def test_skewed_join_is_an_inner_join(spark):
    """Keys above and below the broadcast share give the rows of a plain join."""
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 1500), (2, 3), (3, 1), (4, 2)) for i in range(n)], "k long, i long")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 4")
    joined = skewed_join(rows, counted, ["k"]).collect()
    assert len(joined) == 1504 and all(r.n == {1: 1500, 2: 3, 3: 1}[r.k] for r in joined)


def test_worker_values_go_with_the_first_task_that_holds_none(spark):
    """What one stage leaves in a Python worker would count in all later ones."""
    key = ("test", "held")
    first = shared.per_worker(key, list)
    shared.release_worker(keep=True)
    assert shared.per_worker(key, list) is first
    shared.release_worker()
    assert shared.per_worker(key, list) is not first
    shared.release_worker()
    two = spark.range(2, numPartitions=1)
    count = lambda batches: ({"n": [len(shared.per_worker(key, lambda: [1]))] * len(b["id"])} for b in batches)
    assert [r.n for r in shared.arrow_map(two, count, "n long", holds=True).collect()] == [1, 1]
