"""Forests put together level by level, and pages spliced by byte offsets, against plain Python."""
import html as html_
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tablemill import fixed
from tablemill.operators import export, forest, verdict
from tablemill.operators.store import stored
from tablemill.sources.markup import page_tables


def test_forest_of_random_trees(spark):
    rng, rows, want = random.Random(6), [], {}
    for key in range(30):
        n = rng.choice([1, 2, 9, 40])
        depth = rng.choice([1, 3, 12, n])
        up, level = {}, {}
        for no in range(n):
            able = [k for k in range(no) if level[k] < depth]
            up[no] = rng.choice(able) if able and rng.random() < 0.8 else None
            level[no] = 1 + level.get(up[no], 0)
        places = rng.sample(range(1000), n)
        for no in range(n):
            rows.append((key, no, up[no], places[no] // 30, places[no] % 30, json.dumps({"t": f'"{no}', "k": [no]})))

        def tree(parent):
            kids = sorted((k for k in up if up[k] == parent), key=lambda k: places[k])
            return [{"t": f'"{k}', "k": [k], "children": tree(k)} for k in kids]
        want[key] = tree(None)
    rng.shuffle(rows)
    nodes = stored(spark.createDataFrame(rows, "key int, no int, up int, row int, col int, json string"), "nodes")
    got = {r.key: json.loads(r.forest) for r in forest.nested(nodes, ["key"], ["row", "col"]).collect()}
    assert got == want


def test_a_chain_takes_a_round_per_level_and_nothing_gives_nothing(spark):
    rows = [(0, i, i - 1 if i else None, i, 0, f'{{"n":{i}}}') for i in range(9)]
    schema = "key int, no int, up int, row int, col int, json string"
    nodes = stored(spark.createDataFrame(rows, schema), "chain")
    assert len(forest.levels(nodes, ["key"])) == 9
    text = forest.nested(nodes, ["key"], ["row", "col"]).first().forest
    for _ in range(9):
        (node,) = json.loads(text)
        text = json.dumps(node["children"])
    assert text == "[]"
    assert forest.nested(stored(spark.createDataFrame([], schema), "none"), ["key"], ["row", "col"]).count() == 0


def plain_set(tag, name, value):
    attr = re.compile(rf"""(\s{name})(\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", re.I)
    new = f'{name}="{html_.escape(value)}"'
    found = attr.search(tag)
    if found:
        return tag[:found.start() + 1] + new + tag[found.end():]
    return re.sub(r"\s*(/?>)$", lambda m: " " + new + m.group(1), tag)


TAGS = ["<td>", "<td >", "<td/>", "<td />", "<TD STYLE>", "<td style='a:b' x=1>", '<td x="1" style = "p:q"\nstyle=z>', "<td style=a/b>",
        "<td data-style=1>", "<td title='é \" $1 \\\\'>", "<td styled=1 style>", "<td\tstyle=x >", "<table title>", "<td style=", ""]


@pytest.mark.parametrize("name", ["style", "title"])
def test_attributes_are_set_in_place(spark, name):
    values = ["a:b;c", "<&>\"'", "$1 \\2 é", ""]
    rows = [(t, v) for t in TAGS for v in values]
    got = spark.createDataFrame(rows, "t string, v string").select(
        "t", "v", export._with_attribute(F.col("t"), name, F.col("v")).alias("out")).collect()
    for r in got:
        assert r.out == plain_set(r.t, name, r.v), (r.t, r.v)


def test_splice(spark):
    rng, rows, want = random.Random(8), [], {}
    for i in range(60):
        text, at, edits = "", 0, []
        for _ in range(rng.randint(1, 30)):
            gap, hit = "".join(rng.choices("aé日😀 ", k=rng.randint(0, 5))), "".join(rng.choices("xß", k=rng.randint(0, 3)))
            edits.append((len((text + gap).encode()), len(hit.encode()), str(len(edits)), gap, hit))
            text += gap + hit
        tail = "".join(rng.choices("éz", k=rng.randint(0, 4)))
        edits = edits if len({e[:2] for e in edits}) == len(edits) else edits[:1]
        kept = [e for k, e in enumerate(edits) if k == 0 or e[0] >= edits[k - 1][0] + edits[k - 1][1]]
        raw, out, done = (text + tail).encode(), b"", 0
        for at, n, mark, *_ in kept:
            out += raw[done:at] + b"[" + raw[at:at + n] + mark.encode() + b"]"
            done = at + n
        want[i] = (out + raw[done:]).decode()
        shuffled = [e[:3] for e in kept]
        rng.shuffle(shuffled)
        rows.append((i, text + tail, shuffled))
    frame = spark.createDataFrame(rows, "i int, text string, edits array<struct<at:int,at_len:int,mark:string>>")
    got = frame.select("i", export.spliced(F.col("text"), F.col("edits"), lambda t, e: F.concat(
        F.lit("["), t, e["mark"], F.lit("]"))).alias("out")).collect()
    assert {r.i: r.out for r in got} == want


def test_places_are_bytes():
    page = "<p>日本</p><table title='é'><tr><td>ü</td><td class=ß>1</td></tr><tr><td>a<td>b</table>é<table></table>"
    raw = page.encode()
    for t in page_tables(page):
        assert raw[t["at"]:t["at"] + t["at_len"]].startswith(b"<table")
        assert raw[t["at"]:t["at"] + t["at_len"]].endswith(b">")
        for c in (c for row in t["rows"] for c in row):
            assert raw[c["at"]:c["at"] + c["at_len"]].decode().startswith("<td")
            assert raw[c["at"]:c["at"] + c["at_len"]].decode().endswith(">")


def test_painting_runs_no_python(spark, as_pages):
    pages = as_pages(["<table><tr><th>A<th>B</tr><tr><td>é<td>1</tr><tr><td>y<td>2</tr></table>"])
    judged = stored(verdict.judge(pages), "judged")
    plan = export.annotate_pages(pages, judged)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert fixed.PAGE_GENUINE_STYLE in export.annotate_pages(pages, judged).first().html
