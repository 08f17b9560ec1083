"""Pages read in columns: the same tables as page by page, whatever the markup."""

import random

import pyarrow as pa
import pytest
from conftest import table

from tablemill.sources import columns
from tablemill.sources.markup import page_tables

PIECES = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<TD rowspan=2>", "<td colspan='3'>",
          "<td rowspan=0>", "<td colspan=wide>", '<td data-gt-id="7" style="a">', "<tbody>", "</tbody>", "<p>", "</p>", "<br>",
          "<br/>", "</br>", "<i/>", "<b>", "</b>", "<img src='a'>", "<input>", "<template>", "</template>", "<script>", "</script>",
          "<tr/>", "<td/>", "<!-- x -->", "&amp;", ">", "<", " x ", "1", " й ", "\x1f", "日本", "\n", '<table style="s">']


def _grid(rng):
    """Markup that mostly nests, with now and then something in it that does not."""
    def cell():
        inner = rng.choice(["", "a", " b ", "й ", "<b>c</b> d", "e<br>f", "<i> <b>g</b></i>h", "<a href='#'>k</a>", "\x1c1"])
        tag = rng.choice(["td", "td", "th"])
        return f"<{tag}{rng.choice(['', '', '', ' rowspan=2', ' colspan=2', ' style=s', ' rowspan=0', ' colspan=-1'])}>{inner}</{tag}>"

    def row():
        return "<tr>" + "".join(cell() for _ in range(rng.randint(0, 3))) + "</tr>" + rng.choice(["", "\n", " x "])
    rows = "".join(row() for _ in range(rng.randint(0, 4)))
    out = f"<p>{rng.choice('aй')}</p><table>{rng.choice([rows, f'<tbody>{rows}</tbody>'])}</table>"
    if rng.random() < 0.3:
        at = rng.randrange(len(out))
        out = out[:at] + rng.choice(PIECES) + out[at:]
    return out


def _whole(pages):
    return pa.array([page_tables(p) if p else [] for p in pages], columns.ARROW_TABLES)


@pytest.mark.parametrize("seed", range(6))
def test_columns_agree_with_pages(seed):
    rng = random.Random(seed)
    pages = []
    for _ in range(400):
        soup = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        pages.append(rng.choice([None, "", "text", soup, _grid(rng), _grid(rng), _grid(rng) + _grid(rng), _grid(rng)]))
    for size in (1, 7, 400):
        for at in range(0, len(pages), size):
            html = pa.array([None, *pages[at:at + size]], pa.string()).slice(1)
            found = columns.batch_tables(html)
            found.validate(full=True)
            assert found.to_pylist() == _whole(pages[at:at + size]).to_pylist()


def test_nested_pages_are_not_read_one_by_one(monkeypatch):
    """What made reading dear: a page's cells as dicts."""
    pages = [table(("Имя", "Value"), ("first", "<td rowspan=2><b>1</b><br>2</td>"), ("second",), tag=t) for t in ("td", "th")] * 3
    expected = _whole(pages)
    monkeypatch.setattr(columns, "page_tables", lambda html: 1 / 0)
    assert columns.batch_tables(pa.array(pages)).equals(expected)
    with pytest.raises(ZeroDivisionError):
        columns.batch_tables(pa.array([*pages, "<table><tr><td>unclosed"]))
