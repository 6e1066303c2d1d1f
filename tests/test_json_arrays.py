"""Arrays cut in blocks of any size against the whole parse."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import InvalidValue
from palimpsest.operators import evaluation
from palimpsest.sources import json_arrays

PARTS = ["a", "é😀", '"', "\\", "{", "}", "[", "]", ",", "\n", " ", "x" * 40]


def value(pick, depth=0):
    kind = pick.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return pick.randrange(1000)
    if kind in (1, 2):
        return "".join(pick.choice(PARTS) for _ in range(pick.randrange(6)))
    if kind == 3:
        return [value(pick, depth + 1) for _ in range(pick.randrange(4))]
    return {f"k{i}": value(pick, depth + 1) for i in range(pick.randrange(4))}


def in_blocks(data, size):
    read = lambda at, n: data[at : at + n]
    state, depth, out = 0, 0, []
    for offset in range(0, len(data), size):
        out += [json.loads(v) for _, v in json_arrays.elements(read, offset, size, size, state, depth)]
        ends = json_arrays.summary(read(offset, size))
        state, depth = ends[state][0], depth + ends[state][1]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_any_size_give_each_element_once(seed):
    pick = random.Random(seed)
    rows = [value(pick) for _ in range(pick.randrange(12))]
    data = json.dumps(rows, ensure_ascii=seed % 2 == 0, indent=pick.choice((None, 1))).encode()
    for size in (1, 2, 3, 7, 64, len(data), len(data) + 9):
        assert in_blocks(data, size) == rows


@pytest.mark.parametrize("text", ['{"a": 1}', '["a', "[1, 2", "[{}"])
@pytest.mark.parametrize("size", [1, 2, 100])
def test_what_is_no_array_is_an_error(text, size):
    with pytest.raises(InvalidValue):
        in_blocks(text.encode(), size)


def test_one_file_in_several_tasks(spark, tmp_path):
    rows = [{"id": i, "text": f'"{i}" [{{,\\ é' * (i % 9)} for i in range(300)]
    (tmp_path / "one.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    (tmp_path / "none.json").write_text("")
    (tmp_path / "empty.json").write_text(" [ ] ")
    found = json_arrays.read_array(spark, str(tmp_path), "id long, text string", block_bytes=512)
    assert sorted((r["id"], r["text"]) for r in found.collect()) == [(r["id"], r["text"]) for r in rows]
    tasks = json_arrays.read_elements(spark, str(tmp_path / "one.json"), 512).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 5 and max(r["count"] for r in tasks) < 100
    whole = spark.read.json(str(tmp_path / "one.json"), schema="id long, text string", multiLine=True)
    assert whole.exceptAll(found).isEmpty() and found.exceptAll(whole).isEmpty()


def test_written_arrays_and_damaged_elements(spark, tmp_path):
    rows = spark.range(100).repartition(3).select("id", F.when(F.col("id") % 2 == 0, F.lit("line\nbreak")).alias("text"))
    json_arrays.write_array(rows, str(tmp_path / "w"))
    assert json_arrays.read_array(spark, str(tmp_path / "w"), "id long, text string", 100).exceptAll(rows).isEmpty()
    json_arrays.write_array(rows.limit(0), str(tmp_path / "none"))
    assert json_arrays.read_array(spark, str(tmp_path / "none"), "id long").isEmpty()
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": oops}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        json_arrays.read_array(spark, str(tmp_path / "bad.json"), "id long").collect()


def test_predictions_as_an_array(spark, tmp_path):
    (tmp_path / "p.json").write_text(' \n[{"case_id": "q", "ranked_ids": ["a"]},\n{"case_id": "r", "ranked_ids": []}]')
    assert sorted((r[0], r[1]) for r in evaluation.read_predictions(spark, str(tmp_path / "p.json")).collect()) == [("q", ["a"]), ("r", [])]


def test_small_blocks_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"n": n, "text": "x" * 90} for n in range(3000)]))
    found = json_arrays.read_elements(spark, str(tmp_path), block_bytes=1 << 10)
    assert found.count() == 3000 and found.rdd.getNumPartitions() < 10
