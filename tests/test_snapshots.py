"""Runs compared through their digest trees."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import table
from tablemill.operators import audit
from tablemill.plans import runs, snapshots
from tablemill.session import work_folder


def records_of(spark, change=None):
    rows = []
    for i in range(300):
        html = table(["Name", "Value"], ["a", str(i)], ["b", "2"]) if i % 3 else table(["one"])
        rows.append((str(i), f"r{i}", "u", (change or {}).get(i, html), "genuine" if i % 3 else "no genuine"))
    return spark.createDataFrame([r for r in rows if r[3] is not None],
                                 "key string, name string, url string, html_text string, verification string")


@pytest.fixture(scope="module")
def model(spark):
    return runs.train(records_of(spark), "Logistic Regression")


def taken(spark, records, model, **options):
    path = work_folder(spark, "snapshot")
    snapshots.write_snapshot(records, model, path, **options)
    return snapshots.read_snapshot(spark, path)


@pytest.fixture(scope="module")
def before(spark, model):
    return taken(spark, records_of(spark), model, buckets=32)


def folders(rows):
    return {re.search(r"bucket=(\d+)", f)[1] for f in rows.inputFiles()}


def files_of_scan(rows):
    """The files that the plan's scan opens, folders left out by their bucket not among them."""
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    found = scan.inputRDD().partitions()
    return [f.toPath().toString() for p in found for f in p.files()]


def test_one_changed_table_opens_one_bucket(spark, model, before):
    change = {7: table(["one"])}
    after = taken(spark, records_of(spark, change), model, buckets=32)
    few, changed = snapshots.changed_buckets(before, after)
    assert few == 32 and len(changed["verdicts"]) == len(changed["features"]) == 1 and not changed["failures"]
    (bucket,) = changed["features"]
    for part in ("verdicts", "features"):
        for snapshot in (before, after):
            pruned = snapshots.only_buckets(snapshot[part], few, changed[part])
            files = files_of_scan(pruned)
            assert files and {re.search(r"bucket=(\d+)", f)[1] for f in files} == {str(bucket)}
    diff = {(r.part, r.key): (r.was, r.now) for r in snapshots.compare_snapshots(before, after).where("part <> 'metrics'").collect()}
    assert diff["verdicts", "7"] == ("genuine", "LayoutError") and ("features", "7/0") in diff
    assert {k for _, k in diff} == {"7", "7/0"}       # one table, and nothing besides


def test_tree_adds_up(spark, before):
    assert len(folders(before["features"])) > 20
    for name in snapshots.BUCKETED:
        tree = before["tree"].where(F.col("part") == name)
        top = tree.where("bucket = -1").first()
        sums = tree.where("bucket >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
        assert (top.n, top.a, top.b) == (sums.n, sums.a, sums.b) and top.n == before[name].count()


def test_equal_runs_open_no_bucket(spark, model, before):
    again = taken(spark, records_of(spark).repartition(3), model, buckets=32)
    assert snapshots.changed_buckets(before, again)[1] == {name: [] for name in snapshots.BUCKETED}
    assert snapshots.compare_snapshots(before, again).count() == 0


def test_any_numbers_of_buckets_find_the_same(spark, model, before):
    change = {5: None, 9: None, 8: "<p>none</p>", 40: "<table><tr><td colspan=q>1</td></tr></table>", 41: table(["A", "B"], ["x", "1"], ["y", "é"])}
    records = records_of(spark, change)
    want = None
    for buckets in (16, 32, 256):
        after = taken(spark, records, model, buckets=buckets)
        for one, two in ((before, after), (after, before)):
            few, changed = snapshots.changed_buckets(one, two)
            assert few == min(32, buckets) and max(map(len, changed.values())) <= 5
        diff = sorted(tuple(r) for r in snapshots.compare_snapshots(before, after).collect())
        want = want or diff
        assert diff == want
        plain = []                                                     # without any tree
        for name, part in snapshots.BUCKETED.items():
            plain += [(name, "/".join(str(r[k]) for k in part.key), r.was, r.now) for r in audit.snapshot_diff(
                before[name], after[name], part.key, part.value, part.missing).collect()]
        assert sorted(d for d in diff if d[0] != "metrics") == sorted(plain)
    assert {d[1] for d in want if d[0] == "failures"} == {"40/0"}


def test_buckets(spark, model):
    assert [snapshots.bucket_count(n) for n in (0, 10**5, 10**7, 10**9)] == [16, 16, 128, 16384]
    with pytest.raises(ValueError):
        snapshots.write_snapshot(records_of(spark), model, work_folder(spark, "bad"), buckets=12)


def test_a_run_without_records(spark, model, before):
    none = taken(spark, records_of(spark).where("key = 'none'"), model)
    assert none["features"].columns == before["features"].columns and none["features"].count() == 0
    assert snapshots.compare_snapshots(before, none).where("part = 'verdicts'").count() == 300


def test_a_snapshot_stores_no_cells(spark, monkeypatch):
    """What is written of a table on the way is a small row, whatever its cells, and says the same of it."""
    from tablemill.operators import features, verdict
    from tablemill.sources import tables
    html = "<table><tr><th>a</th><th>b</th></tr>" + "<tr><td>x</td><td>%s</td></tr>" * 2 + "</table>"
    texts = [html % ("5", "6"), html % ("5", "<b>q</b>"), "<p>none</p>", "<table><tr><td colspan=two>1</td></tr></table>", "<table></table>"]
    records = spark.createDataFrame([(str(i), f"n{i}", f"u{i}", t, ["genuine", "no genuine"][i % 2]) for i, t in enumerate(texts * 4)],
                                    "key string, name string, url string, html_text string, verification string")
    judged = verdict.judge(tables.labelled_pages(records))
    for made in (features.features, features.feature_failures):
        assert sorted(made(features.summaries(judged)).collect()) == sorted(made(judged).collect())
    kept = []
    monkeypatch.setattr(snapshots, "stored", lambda rows, name: kept.append(rows.schema) or rows)
    model = runs.train(records, "Logistic Regression")
    snapshots.write_snapshot(records, model, work_folder(spark, "slim"))
    assert kept and not any("array" in f.dataType.simpleString() for schema in kept for f in schema)
