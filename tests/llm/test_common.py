"""What a Python worker keeps between tasks."""

import re
import sys
from pathlib import Path

import pandas as pd
import pytest

from palimpsest.llm import common, pack
from palimpsest.llm.registry import tokenizer_path


def anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_is_given_back():
    def work(batches):
        blocks = [bytearray(2_000) for _ in range(60_000)]
        work.pins = blocks[::500]  # between these, what is freed stays with the allocator
        yield from batches

    before = anonymous_mb()
    assert [len(x) for x in common.giving_back(work)(iter([pd.DataFrame({"a": [1]})]))] == [1]
    assert anonymous_mb() - before < 60


def test_another_stage_drops_what_was_kept(monkeypatch):
    class Task:
        stage = 1

        def stageId(self):  # noqa: N802
            return self.stage

    task = Task()
    monkeypatch.setattr(common.TaskContext, "get", lambda: task)
    first = common.kept("a", object)
    assert common.kept("a", object) is first
    task.stage = 2
    assert common.kept("a", object) is not first
    task.stage = 3
    list(common.giving_back(iter)(iter([])))
    assert not common._KEPT


def test_no_later_stage_holds_the_tokenizer(spark):
    """Workers are reused: those that cut texts into tokens keep no encoder for what comes after."""

    def held(batches):
        import gc

        yield from (pd.DataFrame({"n": [sum(isinstance(x, pack.WordEncoder) for x in gc.get_objects())]}) for _ in batches)

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id bigint, text string").repartition(8)
    assert pack.pieces(docs, tokenizer_path()).count() == 64
    told = spark.range(64).repartition(8).mapInPandas(common.giving_back(held), "n bigint").collect()
    assert {r.n for r in told} == {0}
