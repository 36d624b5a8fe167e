"""JSON arrays in parts: strings full of brackets, small splits, several files, damage."""

import json
import os
import random

import pytest

from tessera.sources import json_arrays, readers, writers


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def items(n):
    rng = random.Random(3)

    def value(depth=0):
        r = rng.random()
        if r < 0.3 and depth < 3:
            return {rng.choice('ab{}"\\'): value(depth + 1) for _ in range(rng.randint(0, 3))}
        if r < 0.5 and depth < 3:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice(["}", "{[", "\\", '"}', 'a\\"}{', "é漢😀", 1, None, True, "\n", "x" * 30, "},{"])

    return [{"id": i, "text": json.dumps(value()), "w": value()} for i in range(n)]


def found(spark, path):
    return [json.loads(r.json) for r in json_arrays.elements(spark, f"file://{path}").orderBy("number").collect()]


@pytest.mark.parametrize("form", ["line", "indented", "one", "empty", "blank"])
def test_elements(spark, small_splits, tmp_path, form):
    rows = items(300)
    text = {"line": json.dumps(rows, ensure_ascii=False), "indented": json.dumps(rows, indent=2), "one": json.dumps(rows[:1]) + "\n", "empty": "[]", "blank": " [ \n] \n"}[form]
    (tmp_path / "x.json").write_text(text)
    assert found(spark, tmp_path / "x.json") == json.loads(text)
    if form == "indented":
        assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}/x.json").rdd.getNumPartitions() > 4


def test_folders_of_arrays(spark, small_splits, tmp_path):
    rows = items(300)
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps(rows[i * 100 : i * 100 + 100]))
    (tmp_path / "p1a.json").write_text("[]")
    assert found(spark, tmp_path) == rows


@pytest.mark.parametrize("text", ['[{"a":1}', '{"a":1}]', '[{"a":1} {"a":2}]', '[{"a":1},,{"a":2}]', '[{"a":"1},{"a":2}]', '{"a":1}', "[1,2]", '[{"a":1},2]', '[{"a":[1}]', "text"])
def test_damage(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="JSON"):
        json_arrays.elements(spark, f"file://{tmp_path}/x.json").collect()


def test_elements_that_do_not_fit(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a":1},{"a":"b"}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_array(spark, f"file://{tmp_path}/x.json", "a int").collect()


def test_written_parts_are_one_array(spark, tmp_path):
    df = spark.createDataFrame([(i, f'}}"{i}', [{"from": "human", "value": "}{"}] * (i % 3)) for i in range(500)], "id long, text string, turns array<struct<from:string,value:string>>").repartition(7)
    writers.json_array(df, f"file://{tmp_path}/out", ["id"])
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    assert len(parts) > 1
    whole = json.loads("".join((tmp_path / "out" / p).read_text() for p in parts))
    assert [r["id"] for r in whole] == list(range(500))
    back = readers.json_array(spark, f"file://{tmp_path}/out", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    writers.json_array(df.limit(0), f"file://{tmp_path}/out", ["id"])
    assert readers.json_array(spark, f"file://{tmp_path}/out", df.schema).collect() == []
