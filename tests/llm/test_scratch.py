"""Intermediate tables go when an operator's plan is made; what the plan reads stays until it has run."""

import os

from revq.llm import common, minhash, mixing
from revq.session import ensure_checkpoint_dir


def held(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(base) if n.startswith("llm-")}


def test_intermediate_tables_go(spark, odd, docs):
    before = held(spark)
    out = minhash.deduplicate(docs)
    left = held(spark) - before
    read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    assert left and left <= read  # nothing is left that the result does not read
    assert out.count() == out.count()  # and nothing is missing that it does
    before = held(spark)
    mixed = mixing.mixed_documents(odd)
    assert held(spark) - before <= {f.rsplit("/", 2)[-2] for f in mixed.inputFiles()}
    assert mixed.count() > 0


def test_tasks_hand_back_arrow_memory(spark, monkeypatch):
    class Frame:
        sparkSession = spark

        def mapInArrow(self, f, schema):
            return f

    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    run = common.in_tasks(Frame(), lambda batches: (2 * b for b in batches), "a long")
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and pool.released == 1
    some = run(iter([1, 2, 3]))  # a task that stops early, as under a limit
    assert next(some) == 2 and pool.released == 1
    some.close()
    assert pool.released == 2
