"""Byte ranges of a JSON document against json.loads and against Spark's multiLine read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from honorlens.plans import ingest
from honorlens.sources import nested
from honorlens.sources.json_array import array_elements, read_array


def tricky(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rnd.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日", "a", "\n", '\\"', "records"]) for _ in range(rnd.randint(0, 9)))
    if kind == 1:
        return rnd.choice([0, -1.5, True, None])
    if kind < 4:
        return rnd.choice(["", "plain", "\\", '"', "\\\\"])
    if kind == 4:
        return [tricky(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["records", "b", 'q"', "\\"]): tricky(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_elements_are_the_parsers(spark, tmp_path, range_bytes):
    rnd = random.Random(range_bytes)
    want = []
    for i in range(6):
        records = [tricky(rnd) for _ in range((0, 1, 25)[i % 3] if range_bytes > 1 else 4)]
        document = {"meta": {"records": [1, 2]}, 'odd "key\\': ["records", [3]], "records": records, "links": [{"records": [9]}]}
        text = json.dumps(document, indent=(None, 2)[i % 2], ensure_ascii=i % 2 == 0)
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
        want += records
    (tmp_path / "none.json").write_text('{"other": [1], "records": "no array"}')
    got = [json.loads(r.value) for r in array_elements(spark, str(tmp_path), "records", range_bytes).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))


def test_a_document_that_is_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [ {"x": "]"} , [1, [2]], "a,b" ,3 ] ')
    (tmp_path / "b.json").write_text("[]")
    got = [json.loads(r.value) for r in array_elements(spark, str(tmp_path), None, 3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [{"x": "]"}, [1, [2]], "a,b", 3]))


@pytest.mark.parametrize("text", ['{"records": [1, 2', '{"records": ["a]}', '{"records": [1]}}'])
def test_a_broken_document_fails_the_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not one whole JSON document"):
        array_elements(spark, str(tmp_path), "records", 4).collect()


def test_many_tasks_read_what_one_multiline_task_reads(spark, tmp_path):
    rnd = random.Random(3)
    records = [{"id": str(i), "givenName": {"en": rnd.choice(["A\\", 'B "q"', "C}"])}, nested.AWARDS_FIELD: [{"awardYear": "1999", "prizeAmount": "12"}] * rnd.randint(0, 2)} for i in range(3000)]
    path = str(tmp_path / "one.json")
    with open(path, "w") as f:
        json.dump({nested.RECORDS_FIELD: records}, f)
    found = read_array(spark, path, nested.RECIPIENT, nested.RECORDS_FIELD, 4096)
    whole = nested.read_documents(spark, path)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert len({r.p for r in array_elements(spark, path, nested.RECORDS_FIELD, 4096).selectExpr("spark_partition_id() AS p").collect()}) > 3


def test_every_shard_is_written_as_one_document(spark, tmp_path):
    rows = spark.range(40000).selectExpr("id % 5 AS shard", "CASE WHEN id < 5 THEN '9' ELSE concat('{\"x\": \"', repeat(id, 20), '\"}') END AS value")
    asked = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        ingest._write_array_files(rows, str(tmp_path / "out"), F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit(', "records": [')), F.lit("]}"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "out").glob("shard=*/part-*"))
    assert len(files) == 5
    for file in files:
        document = json.loads(file.read_text())
        assert document["n"] == 8000 == len(document["records"]) and 9 in document["records"]
