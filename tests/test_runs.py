import json
import random

import pytest
from conftest import table
from pyspark.sql import functions as F

from tablemill import fixed
from tablemill.functions.ranking import exact_rank, stratified_folds
from tablemill.operators import audit, export, features, learn, links, verdict
from tablemill.operators.store import stored
from tablemill.plans import runs, snapshots
from tablemill.session import work_folder
from tablemill.sources import tables
from tablemill.streaming import score as streaming

TOTALS = table(["<td rowspan=2>R</td>", "<td colspan=2>G</td>"], ["a", "b"], ["x", "1", "2"],
               ["y", "3", "4"], ["<td colspan=2>Sum</td>", "6"])


def test_export_document(as_pages):
    pages = as_pages(["<title>T</title>" + TOTALS])
    pathed = stored(links.paths(verdict.roles(verdict.judge(pages))), "pathed")
    document = json.loads(export.export_documents(
        pathed, export.page_sources(pages)).first().document)
    assert document["format"] == fixed.EXPORT_FORMAT and document["orientation"] == "top"
    assert document["source"] == {"url": "u0", "title": "T", "index": 0}
    assert document["size"] == {"rows": 5, "cols": 3}
    assert [n["text"] for n in document["header"]] == ["R", "G"]
    assert [n["text"] for n in document["header"][1]["children"]] == ["a", "b"]
    cells = {(c["row"], c["col"]): c for c in document["cells"]}
    assert cells[3, 2]["header_path"] == ["G", "b"] and cells[3, 2]["sidebar_path"] == ["y"]
    assert cells[4, 2]["aggregates"] == [[2, 2], [3, 2]] and "aggregates" not in cells[3, 2]


def test_sections_nest_whatever_stands_below_them(as_pages):
    html = table(["A", "B"], ["<td colspan=2>Part</td>"], ["x", "1"], ["y", "2"])
    pathed = links.paths(verdict.roles(verdict.judge(as_pages([html]))))
    header = json.loads(export.forests(pathed).first().header)
    assert [(n["text"], [c["text"] for c in n["children"]]) for n in header] == [
        ("A", ["Part"]), ("B", [])]


def test_analyze_lists_numbered_cells(as_pages):
    numbered, n = TOTALS, 0
    while "<td>" in numbered:
        numbered, n = numbered.replace("<td>", f'<td data-gt-id="{n}">', 1), n + 1
    pages = as_pages([numbered, table(["one"]), table(["A", "<td colspan=q>1</td>"])])
    judged = stored(verdict.judge(pages), "judged")
    pathed = stored(links.paths(verdict.roles(judged)), "pathed")
    got = {r.page_id: r for r in export.analyze(
        judged, export.described(pathed),
        export.export_documents(pathed, export.page_sources(pages))).collect()}
    assert got[0].genuine and got[0].reason is None and json.loads(got[0].export)
    total = [c for c in got[0].cells.values() if c.role == "result"][0]
    assert total.lines == [fixed.HINT_TOTAL_COUNT + "2", fixed.HINT_TOTAL]
    assert len(total.highlight) == 2
    assert not got[1].genuine and got[1].reason.startswith("LayoutError") and got[1].cells is None
    assert got[2].reason.startswith(fixed.PROGRAM_ERROR_TEXT + "ValueError")


def test_painted_page_keeps_everything_else(as_pages):
    html = '<p title=x>é</p>' + table(["A", "B"], ['<td style="top:0">x</td>', "1"], ["y", "2"]) \
        + table(["a"]) + "<p>end"
    pages = as_pages([html, "<p>no table</p>"])
    got = {r.page_id: r for r in export.annotate_pages(pages, verdict.judge(pages)).collect()}
    assert got[1].html == "<p>no table</p>" and (got[1].tables, got[1].genuine) == (0, 0)
    page = got[0].html
    assert (got[0].tables, got[0].genuine) == (2, 1)
    assert f'<td style="top:0;{fixed.PAGE_STYLE["sidebar"]}">x</td>' in page
    assert fixed.PAGE_REJECTED_STYLE in page and page.startswith("<p title=x>é</p><table title=")
    import re
    plain = re.sub(r' (title|style)="(подлинная|неподлинная[^"]*|outline[^"]*|background[^"]*)"', "", page)
    assert plain.replace(";" + fixed.PAGE_STYLE["sidebar"], "") == html


def test_sheet_letters(spark):
    cols = [0, 25, 26, 51, 52, 701, 702, 727, 728, 18277]
    got = spark.createDataFrame([(c,) for c in cols], "c long").select(
        export._letters(F.col("c")).alias("a")).collect()
    assert [r.a for r in got] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA", "ZZZ"]


def test_ranks_and_folds_in_one_hot_group(spark):
    rows = stored(spark.range(20000).select(
        F.col("id"), F.when(F.col("id") % 50 == 0, "genuine").otherwise("no genuine").alias("label")),
        "rows")
    ranks = exact_rank(rows, ["label"], F.md5(F.col("id").cast("string")), "rank")
    per = ranks.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"),
                                     F.max("rank").alias("top")).collect()
    assert all(r.n == r.d == r.top for r in per)
    folds = stratified_folds(rows, "label", "id").groupBy("label", "fold").count().collect()
    assert len(folds) == 10 and all(r["count"] in (80, 3920) for r in folds)


def test_features_of_an_empty_table(as_pages):
    got = features.features(verdict.judge(as_pages(["<table></table>"]))).first()
    assert all(got[f] == -1 for f in fixed.FEATURES) and got.consistency == -1


def test_digest_ignores_order_but_not_values(as_pages):
    pages = as_pages([table(["A", "B"], ["x", str(i)], ["y", "2"]) for i in range(40)])
    rows = features.features(verdict.judge(pages))
    one = features.matrix_digest(rows).first()
    assert features.matrix_digest(rows.repartition(7, "numeric").orderBy(F.desc("page_id"))).first() == one
    assert features.matrix_digest(rows.withColumn("form", F.lit(.5))).first() != one


def scores_by_hand(pairs):
    labels = {x for p in pairs for x in p}
    f1, support = {}, {}
    for label in labels:
        tp = sum(a == b == label for a, b in pairs)
        support[label] = sum(a == label for a, _ in pairs)
        said = sum(b == label for _, b in pairs)
        f1[label] = 2 * tp / (support[label] + said) if support[label] + said else 0
    return (sum(f1[x] * support[x] for x in labels) / len(pairs), sum(f1.values()) / len(labels),
            sum(a == b for a, b in pairs) / len(pairs))


def test_fold_scores(spark):
    rng = random.Random(1)
    pairs = [(rng.choice("ab"), rng.choice("aab")) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "verification string, prediction string")
    got = learn.fold_scores(rows.withColumn("fold", F.lit(0)), ["fold"]).first()
    assert [got.f1_weighted, got.f1_macro, got.accuracy] == pytest.approx(scores_by_hand(pairs))


def test_scores_are_zero_safe(spark):
    rows = spark.createDataFrame([("no genuine", "no genuine")], "verification string, p string")
    got = audit.scores(audit.confusion(rows, "p")).first()
    assert (got.tn, got.precision, got.recall, got.f1) == (1, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def records(spark):
    """Records whose label depends on what fills the table, some unreadable, some unlabelled."""
    rng, rows = random.Random(9), []
    for i in range(160):
        link = i % 2
        cell = (lambda: f'<a href="#">{rng.randint(1, 9)}x</a>') if link else (lambda: str(rng.randint(1, 99)))
        html = table(["A", "B"], ["x", cell()], ["y", cell()], *[[f"z{k}", cell()] for k in range(i % 3)])
        if i % 20 == 7:
            html = "<p>no table</p>" if i % 40 == 7 else table(["A", "<td colspan=z>1</td>"])
        label = "None" if i % 15 == 4 else "no genuine" if link else "genuine"
        rows.append((str(i), f"r{i}", f"u{i}", html, label))
    return stored(spark.createDataFrame(
        rows, "key string, name string, url string, html_text string, verification string"), "records")


def test_labelled_documents_round_trip(spark, records):
    path = work_folder(spark, "json")
    pack = F.map_from_entries(F.collect_list(F.struct("key", F.struct(
        "name", "url", "html_text", "verification"))))
    records.groupBy((F.col("key").cast("int") % 4).alias("g")).agg(pack.alias("m")).select(
        F.to_json("m")).write.text(path)
    assert tables.read_labelled(spark, path, labelled_only=False).count() == 160
    assert tables.read_labelled(spark, path, wholetext=False).count() == \
        records.where("verification <> 'None'").count()


@pytest.mark.parametrize("name,settings", [
    ("Logistic Regression", {}), ("Random Forest", {"numTrees": 20}),
    ("CatBoost", {"maxIter": 5}), ("SVM (RBF)", {"maxIter": 20})])
def test_models_learn_and_gate(records, name, settings):
    known = records.where("verification <> 'None'")
    rows = runs.labelled_features(known)
    model = learn.fit(name, rows, **settings)
    predicted = model.predict(rows)
    assert predicted.where("consistency = 1 AND prediction <> verification").count() == 0
    assert predicted.where("consistency <> 1 AND prediction <> 'no genuine'").count() == 0
    inline = model.predict_inline(rows).select("page_id", "prediction")
    assert inline.exceptAll(predicted.select("page_id", "prediction")).count() == 0


def test_unknown_model(records):
    with pytest.raises(ValueError):
        runs.train(records, "No Such Model")


def test_cross_validation_and_importance(records):
    rows = runs.labelled_features(records.where("verification <> 'None'"))
    per_fold = learn.cross_validate(rows, ["Logistic Regression"])
    assert per_fold.count() == 5 and per_fold.where("accuracy < 0.99").count() == 0
    best = learn.ranked(learn.summary(per_fold)).first()
    assert best.place == 1 and best.f1_weighted_std == pytest.approx(0, abs=1e-9)
    drops = {r.feature: r.importance for r in learn.permutation_importance(
        rows, "Logistic Regression", folds=2, repeats=3).collect()}
    assert set(drops) == set(fixed.FEATURES) and drops["form"] == 0
    assert max(drops.values()) > 0.05


def test_labelled_keys_stay_as_they_are(spark):
    """Keys that are no numbers, keys with leading zeros, the same key in two files."""
    path = work_folder(spark, "odd-keys")
    good = table(["A", "B"], ["x", "1"], ["y", "2"])
    for part, keys in enumerate([["a1", "007", "7"], ["7", "é b"]]):
        record = {k: {"name": k, "url": "u", "html_text": good if k != "7" or part else table(["one"]),
                      "verification": "genuine"} for k in keys}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{path}/{part}")
    records = stored(tables.read_labelled(spark, f"{path}/*"), "odd")
    judged = verdict.judge(tables.labelled_pages(records))
    got = sorted((r.key, r.verdict) for r in audit.record_verdicts(records, judged).collect())
    assert got == [("007", "genuine"), ("7", "LayoutError"), ("7", "genuine"), ("a1", "genuine"), ("é b", "genuine")]
    assert runs.labelled_features(records).count() == 5


def test_snapshots_and_stream(spark, records):
    model = runs.train(records.where("verification <> 'None'"), "Logistic Regression")
    a, b = work_folder(spark, "a"), work_folder(spark, "b")
    snapshots.write_snapshot(records, model, a)
    changed = records.withColumn("html_text", F.when(F.col("key") == "2", "<table></table>")
                                 .otherwise(F.col("html_text"))).where("key <> '6'")
    snapshots.write_snapshot(changed, model, b)
    before, after = snapshots.read_snapshot(spark, a), snapshots.read_snapshot(spark, b)
    assert snapshots.compare_snapshots(before, before).count() == 0
    diff = {(r.part, r.key): (r.was, r.now) for r in snapshots.compare_snapshots(before, after).collect()}
    assert diff["verdicts", "2"] == ("genuine", "LayoutError")
    assert diff["verdicts", "6"] == ("genuine", fixed.MISSING_RECORD)
    assert diff["predictions", "6/0"] == ("genuine", fixed.MISSING_PREDICTION)
    assert before["failures"].count() == 4
    delta = {(r.stage, r.metric): r.delta for r in audit.compare_metrics(
        before["metrics"], after["metrics"]).collect()}
    assert delta["rule", "tp"] == -2 and delta["rule", "fn"] == 1
    assert ("metrics", "rule/tp") in diff
    assert [x["digest"].first().records for x in (before, after)] == [160, 159]

    source, out = work_folder(spark, "in"), work_folder(spark, "out")
    pages = tables.labelled_pages(records)
    pages.repartition(3).write.parquet(source)
    stream = streaming.read_page_stream(spark, source, streaming.PAGE_SCHEMA.replace("page_id long", "page_id string"),
                                        files_per_batch=1)
    streaming.score_stream(stream, model, out, work_folder(spark, "cp")).awaitTermination()
    batch = runs.score(pages, model)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 3
    assert got.select(batch.columns).exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_a_stream_is_planned_once(spark, records, monkeypatch):
    """However many batches come, scoring is stated once, and what leaves is what the batch run says."""
    from tablemill.streaming import score as module
    pages = tables.labelled_pages(records)
    model = runs.train(records.where("verification <> 'None'"), "Logistic Regression")
    asked = []
    monkeypatch.setattr(module, "score", lambda *a: asked.append(a) or runs.score(*a))
    source, out = work_folder(spark, "in-once"), work_folder(spark, "out-once")
    pages.repartition(4).write.parquet(source)
    stream = module.read_page_stream(spark, source, module.PAGE_SCHEMA.replace("page_id long", "page_id string"), files_per_batch=1)
    module.score_stream(stream, model, out, work_folder(spark, "cp-once")).awaitTermination()
    got, batch = spark.read.parquet(out), runs.score(pages, model)
    assert len(asked) == 1 and got.select("batch").distinct().count() == 4
    assert got.select(batch.columns).exceptAll(batch).count() == 0 and got.count() == batch.count()
