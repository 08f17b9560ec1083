"""One large JSON map read in many blocks, against the plain reader."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tablemill.sources import json_map, tables

PARTS = ["{", "}", "}}", '"', "\\", "\\\\", '\\"', "<td>", "é", "日", "😀", "\n", " ", ",", ":", "[", "]", "a", "style{b:c}", '":{"']


def document(rng, n, indent):
    out = {}
    for i in range(n):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 60)))
        record = {"name": "".join(rng.choices(PARTS, k=3)), "url": f"u{i}", "html_text": "<p>" + text, "verification": rng.choice(["genuine", "no genuine"])}
        if i % 5 == 0:
            record["more"] = {"deep": [{"x": "}{"}, {}], "t": text}
        out[f'k{i}{rng.choice(PARTS)}'] = record
    return out, json.dumps(out, ensure_ascii=rng.random() < 0.5, indent=indent)


@pytest.fixture
def small_blocks(spark):
    """Many blocks, one to a task, and rows of one block in one task."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_entries_of_maps_with_braces_in_strings(spark, tmp_path, small_blocks, indent):
    rng = random.Random(str(indent))
    want = {}
    for name in ("a", "b"):
        held, text = document(rng, 60, indent)
        (tmp_path / f"{name}.json").write_text(text, "utf-8", newline="")
        want[name] = held
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {"a": {}, "b": {}}
    for r in json_map.entries(spark, str(tmp_path)).collect():
        ((key, record),) = json.loads(r.json).items()
        got[r.file[-6]][key] = record
    assert got == want


def test_records_are_those_of_the_plain_reader(spark, tmp_path, small_blocks):
    held, text = document(random.Random(5), 80, 2)
    (tmp_path / "one.json").write_text(text, "utf-8", newline="")
    columns = ["key", "name", "url", "html_text", "verification"]
    by_row = [sorted(map(tuple, tables.read_labelled(spark, str(tmp_path), **how).select(*columns).collect()))
              for how in ({"split": True}, {"wholetext": True})]
    assert by_row[0] == by_row[1] and len(by_row[0]) == len(held)


def test_lines_empty_files_and_what_is_not_closed(spark, tmp_path):
    texts = {"lines": '{"a":{"name":"1"}}\n{}\n{"b":{"name":"{"},"c":{"name":"\\\\"}}\n', "none": "", "empty": "{}", "blank": " \n",
             "open": '{"d":{"name":"x"},"e":{"name":"y'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = sorted(r.json for r in json_map.entries(spark, str(tmp_path)).collect())
    assert [json.loads(g) for g in got] == [{"a": {"name": "1"}}, {"b": {"name": "{"}}, {"c": {"name": "\\"}}, {"d": {"name": "x"}}]


def test_a_large_map_takes_many_tasks(spark, tmp_path):
    """30 MB in blocks of 1 MB; no task holds more than its block and no row more than a record."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        page = "<table>" + "<tr><td>{x}</td><td>\\\"1\\\"</td></tr>" * 60 + "</table>"
        with open(tmp_path / "large.json", "w") as out:
            out.write("{")
            for i in range(12_000):
                out.write(f'{"," if i else ""}"{i}": {{"name": "n{i}", "url": "u", "html_text": "{page}", "verification": "genuine"}}')
            out.write("}")
        cut = json_map.fragments(spark, str(tmp_path))
        assert cut.select("block").distinct().count() >= 25
        records = tables.read_labelled(spark, str(tmp_path), split=True)
        got = records.agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min(F.length("html_text")).alias("a"),
                          F.max(F.length("html_text")).alias("b")).first()
        assert (got.n, got["keys"]) == (12_000, 12_000) and got.a == got.b == len(page.replace("\\", ""))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
