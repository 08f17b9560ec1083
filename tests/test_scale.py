"""What grows with the input stays off the driver and out of single tasks."""

import pytest
from conftest import table
from pyspark.sql import functions as F

from tablemill.operators import audit, export, links, verdict
from tablemill.operators.store import stored


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


PAGES = ["<title>a</title>" + table(["Name", "Value"], ["first", "1"], ["second", "2"]), "<p>none</p>",
         table(["Name", "Value", "Note"], ["first", "1"]) + table(["K", "V"], ["x", "3"], ["y", "4"], ["z", "5"])]


@pytest.fixture(scope="module")
def judged(as_pages):
    return stored(verdict.judge(as_pages(PAGES)), "judged")


def test_edits_are_not_sent_through_the_driver(as_pages, judged):
    """Edits look small by the files behind them; a few hundred bytes a page of them failed at 900,000 pages."""
    painted = export.annotate_pages(as_pages(PAGES), judged)
    assert "Broadcast" not in plan(painted)
    assert {r.page_id: (r.tables, r.genuine) for r in painted.collect()} == {0: (1, 1), 1: (0, 0), 2: (2, 1)}


def test_exports_and_answers_are_not_sent_through_the_driver(as_pages, judged):
    pages = as_pages(PAGES)
    found = stored(links.paths(verdict.roles(judged)), "pathed")
    documents = export.export_documents(found, export.page_sources(pages))
    answers = export.without_tables(pages, export.analyze(judged, export.described(found), documents))
    for rows in (documents, answers, audit.page_summary(pages, verdict.verdicts(judged))):
        assert "Broadcast" not in plan(rows)
    assert documents.count() == 2 and answers.count() == 4
    assert answers.where("genuine").select(F.get_json_object("export", "$.source.title")).first()[0] == "a"


TEXTS = ["", " ", "-", " n/a ", "12", "12\n", "1 2", "007", "\u0663\u0664", "1.5", "1,234.50", "$5", "5 %", "5%", "12:30", "1:2", "12:30 PM",
         "1/2/2020", "1.2.3", "1 2 3", "May 5, 2020", "\u043c\u0430\u0440\u0442 2020", "Jan '20", "5 kg", "a1", "x", "\u00a0", "3-4-5", "12-", None]


def test_shortcuts_of_cell_types_change_no_type(spark):
    """Texts of digits, bare cells and texts that lack a sign skip patterns that they cannot meet."""
    from tablemill import fixed
    from tablemill.functions import cell_types as ct
    text = F.col("text")
    dates = ct._any_of(text, fixed.DATE_PATTERNS, ignore_case=True)
    times, percents = ct._any_of(text, fixed.TIME_PATTERNS), text.rlike(ct.java_regex(fixed.PERCENT_PATTERN))
    slow = F.when(text.rlike(r"\p{Nd}"), F.when(dates, "DATE").when(times, "TIME").when(ct.is_money(text), "MONEY").when(percents, "PERCENT")
                  .when(ct.is_measurement(text), "MEASUREMENT").when(ct.is_dimension(text), "DIMENSION"))
    bare, formatted = F.array(F.lit("td")), F.array(F.lit("b"), F.lit("td"))
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(
        "text", dates.eqNullSafe(ct.is_date(text)).alias("date"), times.eqNullSafe(ct.is_time(text)).alias("time"),
        percents.eqNullSafe(ct.is_percent(text)).alias("percent"), slow.eqNullSafe(ct.number_kind(text)).alias("kind"),
        ct.detail_type(bare, text).eqNullSafe(ct.detail_type(formatted, text)).alias("bare"))
    assert rows.where("NOT (date AND time AND percent AND kind AND bare)").collect() == []


def test_pages_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """One small file of many rows is rendered by more than its one task, or one for each core."""
    from tablemill.sources import rendered
    monkeypatch.setattr(rendered, "TASK_PAGES", 10)
    spark.range(1000).selectExpr("id AS event_id", "'view' AS event_type", "id / 100.0D AS value").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    pages = rendered.event_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == 100 and pages.select("page_id").distinct().count() == 1000


def test_one_pass_reads_pages_as_the_tree_does():
    """Pages that the one-pass reader takes come out as from the tree of nodes."""
    import random

    from tablemill.sources import markup
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td rowspan=2>", "<th colspan='3'>", "</th>", "a", " b ", "&amp;", "&#65;",
              "<br>", "</br>", "<br/>", "<td/>", "<p/>", "<rt>", "</rt>", "<b>", "</b>", "<TD a=1 STYLE>", "é", "<p>", "</p>", "<hr/>"]
    rng, read = random.Random(3), 0
    for _ in range(4000):
        html = "".join(rng.choices(pieces, k=rng.randint(1, 40)))
        flat = markup.read_flat(html)
        if flat:
            tree = markup._Tree()
            assert tree.read_plain(html) and not tree.tr_in_tr
            assert flat == markup._flat(tree)[0], html
            read += 1
    assert read > 1000
    assert markup.read_flat("<table><tr><td><script>x</script></table>") is None and markup.read_flat("a < b") is None
