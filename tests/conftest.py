import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablemill.session import build_session
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_pages(spark):
    """HTML texts -> pages numbered from 0."""
    def make(texts):
        return spark.createDataFrame(
            [(i, f"u{i}", t) for i, t in enumerate(texts)],
            "page_id long, url string, html string")
    return make


def table(*rows, tag="td"):
    """Rows of cells to markup; a text that begins with ``<td`` or ``<th`` stays as it is."""
    def cell(c):
        return c if c.startswith(("<td", "<th")) else f"<{tag}>{c}</{tag}>"
    return "<table>" + "".join(
        "<tr>" + "".join(cell(c) for c in row) + "</tr>" for row in rows) + "</table>"
