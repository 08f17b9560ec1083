import random

from conftest import table
from tablemill.sources import markup
from tablemill.sources.markup import page_tables


def texts(html, nth=0):
    return [[c["text"] for c in row] for row in page_tables(html)[nth]["rows"]]


def test_shapes():
    assert texts("<table></table>") == [[]]
    assert texts("<table><td>a</td><td>b</td></table>") == [["a", "b"]]
    assert texts("<table><tr> </tr><tr><td>a</td></tr></table>") == [["a"]]
    assert texts(table(["a", "b"], ["c"])) == [["a", "b"], ["c"]]
    assert page_tables("<p>none</p>") == []


def test_unclosed_rows_and_cells():
    assert texts("<table><tr><td>1</td><tr><td>2</td><tr><td>3</td></table>") == [["1"], ["2"], ["3"]]
    nested = "<table><tr><td>0</td><tr><td>1</td></tr><tr><td>2</td></tr></tr></table>"
    assert texts(nested) == [["0"], ["2"], ["1"]]
    assert texts("<table><td>1<td>2</table>") == [["1 2", "2"]]


def test_nested_tables_count_and_repeat():
    html = table(["x", "<td>in" + table(["a", "b"]) + "</td>"], ["y", "z"])
    assert [t["table_idx"] for t in page_tables(html)] == [0, 1]
    assert texts(html) == [["x", "in a b", "a", "b"], ["a", "b"], ["y", "z"]]
    assert texts(html, 1) == [["a", "b"]]
    cells = [c for row in page_tables(html)[0]["rows"] for c in row]
    assert [(c["home_row"], c["home_col"]) for c in cells if c["text"] == "a"] == [(1, 0)] * 2


def test_text_and_tags():
    html = "<table><tr><td>a &amp; b<script>x<y</script><!-- c --><b> d </b>&#150;<br></td></tr></table>"
    cell = page_tables(html)[0]["rows"][0][0]
    assert cell["text"] == "a & b d –"
    assert cell["tags"] == ["b", "br", "script", "td"]
    assert html[cell["at"]:cell["at"] + cell["at_len"]] == "<td>"


def test_bad_spans_only_fail_their_table():
    html = table(["<td colspan=x>1</td>"]) + table(["a"])
    assert [t["status"] for t in page_tables(html)] == ["bad_span", "ok"]
    assert page_tables(table(["<td colspan>1</td>"]))[0]["status"] == "bad_span"


def test_places():
    html = table(["<td rowspan=2>a</td>", "<td colspan=2>b</td>"], ["c", "d"], ["e"])
    got = {c["text"]: (c["row"], c["col"]) for row in page_tables(html)[0]["rows"] for c in row}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 1), "d": (1, 2), "e": (2, 0)}
    wide = page_tables(table(["<td colspan=2000000000 rowspan=2000000000>a</td>", "b"], ["c"]))[0]
    assert [c["col"] for row in wide["rows"] for c in row] == [0, 2000000000, 2000000000]


def test_long_unclosed_rows_stay_linear():
    html = "<table>" + "<tr><td>1</td>" * 20000 + "</table>"
    assert len(page_tables(html)[0]["rows"]) == 20000


PARTS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<td rowspan=2 colspan="3">',
         "<th colspan='2' class=x>", "</th>", "text ", "a & b", "&amp;", "&#150;", "&nbsp;", "&foo;",
         "< 5", "<br>", "<br/>", "</br>", "<b>", "</b>", "</p>", "<!-- c -->", "<!-- <td> -->",
         "<script>if(a<b)x</script>", "<style>p{}</style>", '<img src="a>b.png" alt=\'x\'/>',
         "<TD ROWSPAN=2>", "<td colspan>", '<td style="a:b" style="c:d">', "<!DOCTYPE html>",
         '<a href="?a=1&amp;b=2">', "</a>", "<rt>r</rt>", "<template>", "</template>", "&copy",
         "<tr/>", "<td/>", "x<y", "&", "<textarea>", "<script>a</b></script>"]


def test_both_readers_agree(monkeypatch):
    rng = random.Random(7)
    soups = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(4000)]
    fast = [page_tables(s) for s in soups]
    monkeypatch.setattr(markup, "_read", lambda html: markup._Reader(html).tree)
    assert [page_tables(s) for s in soups] == fast
