"""Answers stated from the relational tables, in SQL, without reading any markup.

Fragments only: ``registry`` puts them together per query.
"""

from __future__ import annotations

from .. import fixed

# ---------------------------------------------------------------- documents
DOC = """
doc_l AS (
  SELECT doc_id, doc_id * 4 AS page_id, i, i // 5 AS b, n, (n + 4) // 5 AS nb, line,
         len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words,
         length(line) AS chars
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
doc_b AS (
  SELECT page_id, b, any_value(n) AS n, least(5 * (b + 1), any_value(n)) AS e,
         sum(words) AS words, sum(chars) AS chars, count(*) AS k FROM doc_l GROUP BY page_id, b),
doc_t AS (
  SELECT page_id, any_value(n) AS n, any_value(nb) AS nb, sum(words) AS words,
         sum(chars) + CASE WHEN any_value(doc_id) % 3 = 0 THEN 1 ELSE 0 END AS chars
  FROM doc_l GROUP BY page_id),
doc_c AS (
  SELECT page_id, 0 AS row, col, 1 AS rowspan, 1 AS colspan, text, 'title' AS role,
         'STRING' AS detail, 'th' AS tag, 'th' AS tags, 0 AS src_row, col AS src_idx,
         NULL::BIGINT AS b, NULL::BIGINT AS i
  FROM doc_t, (VALUES (0,'Block'),(1,'Line'),(2,'Kind'),(3,'Words'),(4,'Chars')) AS h(col, text)
  UNION ALL
  SELECT page_id, 1 + 5 * b + b, 0, k, 1, 'Block ' || (b + 1), 'sidebar', 'STRING', 'td', 'td',
         1 + 5 * b + b, 0, b, NULL FROM doc_b
  UNION ALL
  SELECT page_id, 1 + i + b, c.col, 1, 1,
         CASE c.col WHEN 1 THEN 'Line ' || (i + 1) WHEN 2 THEN CASE WHEN words > 50 THEN 'long' ELSE 'short' END
                    WHEN 3 THEN CASE WHEN words = 0 THEN '-' ELSE words::VARCHAR END
                    ELSE chars::VARCHAR END,
         CASE WHEN c.col = 1 AND n % 5 <> 1 THEN 'sidebar' ELSE 'data' END,
         CASE WHEN c.col < 3 THEN 'STRING' WHEN c.col = 3 AND words = 0 THEN 'NO_DATA'
              ELSE 'DIMENSION' END, 'td', 'td', 1 + i + b,
         c.col - CASE WHEN i % 5 = 0 THEN 0 ELSE 1 END, b, i
  FROM doc_l, (VALUES (1),(2),(3),(4)) AS c(col)
  UNION ALL
  SELECT page_id, 1 + e + b, c.col, 1, CASE WHEN c.col = 1 THEN 2 ELSE 1 END,
         CASE c.col WHEN 0 THEN '' WHEN 1 THEN 'Subtotal' WHEN 3 THEN words::VARCHAR
                    ELSE chars::VARCHAR END, 'result',
         CASE c.col WHEN 0 THEN 'NO_DATA' WHEN 1 THEN 'STRING' ELSE 'DIMENSION' END,
         'td', CASE WHEN c.col = 1 THEN 'b,td' ELSE 'td' END, 1 + e + b,
         CASE WHEN c.col < 2 THEN c.col ELSE c.col - 1 END, b, NULL
  FROM doc_b, (VALUES (0),(1),(3),(4)) AS c(col)
  UNION ALL
  SELECT page_id, 1 + n + nb, c.col, 1, CASE WHEN c.col = 0 THEN 3 ELSE 1 END,
         CASE c.col WHEN 0 THEN 'Total' WHEN 3 THEN words::VARCHAR ELSE chars::VARCHAR END,
         'result', CASE c.col WHEN 0 THEN 'STRING' ELSE 'DIMENSION' END, 'td', 'td', 1 + n + nb,
         CASE WHEN c.col = 0 THEN 0 ELSE c.col - 2 END, NULL, NULL
  FROM doc_t, (VALUES (0),(3),(4)) AS c(col)),
doc_p AS (
  SELECT c.*, CASE WHEN role = 'title' THEN '' ELSE
           CASE col WHEN 0 THEN 'Block' WHEN 1 THEN 'Line' WHEN 2 THEN 'Kind' WHEN 3 THEN 'Words'
                    ELSE 'Chars' END END AS header,
         CASE WHEN i IS NULL THEN '' WHEN col = 1 OR n % 5 = 1 THEN 'Block ' || (b + 1)
              ELSE 'Block ' || (b + 1) || ' > Line ' || (i + 1) END AS sidebar
  FROM doc_c c JOIN (SELECT page_id AS pid, n FROM doc_t) t ON pid = c.page_id),
doc_links AS (
  SELECT l.page_id, 1 + bl.e + l.b AS total_row, c.col AS total_col, 1 + l.i + l.b AS data_row,
         CASE WHEN c.col = 3 THEN l.words ELSE l.chars END AS value,
         CASE WHEN c.col = 3 THEN bl.words ELSE bl.chars END AS stated, c.col = 3 AND l.words = 0 AS empty
  FROM doc_l l JOIN doc_b bl ON bl.page_id = l.page_id AND bl.b = l.b, (VALUES (3),(4)) AS c(col)
  UNION ALL
  SELECT l.page_id, 1 + t.n + t.nb, c.col, 1 + l.i + l.b,
         CASE WHEN c.col = 3 THEN l.words ELSE l.chars END,
         CASE WHEN c.col = 3 THEN t.words ELSE t.chars END, c.col = 3 AND l.words = 0
  FROM doc_l l JOIN doc_t t ON t.page_id = l.page_id, (VALUES (3),(4)) AS c(col))
"""


def sql_money(value: str) -> str:
    cents = f"CAST(round({value} * 100) AS BIGINT)"
    return (f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || '$' || (abs({cents}) // 100) || '.' "
            f"|| lpad((abs({cents}) % 100)::VARCHAR, 2, '0'))")


# ---------------------------------------------------------------- orders and customers
ORD = f"""
ord_c AS (
  SELECT o_orderkey * 4 + 1 AS page_id, k.row, c.col, 1 AS rowspan, 1 AS colspan,
         CASE WHEN c.col = 0 THEN k.name ELSE CASE k.row
           WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'Customer no ' || o_custkey
           WHEN 2 THEN o_orderstatus WHEN 3 THEN {sql_money('o_totalprice')}
           ELSE o_orderpriority END END AS text,
         CASE WHEN c.col = 0 THEN 'title' ELSE 'data' END AS role,
         CASE WHEN c.col = 1 AND k.row = 0 THEN 'DATE' WHEN c.col = 1 AND k.row = 3 THEN 'MONEY'
              ELSE 'STRING' END AS detail, 'td' AS tag,
         CASE WHEN c.col = 1 AND k.row = 2 THEN 'i,td' ELSE 'td' END AS tags,
         k.row AS src_row, c.col AS src_idx,
         CASE WHEN c.col = 1 THEN k.name ELSE '' END AS header, '' AS sidebar
  FROM orders, (VALUES (0,'Placed'),(1,'Customer'),(2,'Status'),(3,'Price'),(4,'Priority'))
       AS k(row, name), (VALUES (0),(1)) AS c(col))
"""
CUS = f"""
cus_c AS (
  SELECT c_custkey * 4 + 2 AS page_id, x.row, x.col, x.rowspan, x.colspan,
         CASE x.t WHEN 'region' THEN r_name WHEN 'name' THEN c_name WHEN 'nation' THEN n_name
                  WHEN 'bal' THEN {sql_money('c_acctbal')} WHEN 'bal2' THEN {sql_money('c_acctbal * 2')}
                  WHEN 'seg' THEN c_mktsegment ELSE x.t END AS text,
         x.role, CASE WHEN x.t LIKE 'bal%' THEN 'MONEY' ELSE 'STRING' END AS detail,
         CASE WHEN x.row < 2 THEN 'th' ELSE 'td' END AS tag,
         CASE WHEN x.row < 2 THEN 'th' ELSE 'td' END AS tags, x.row AS src_row, x.src_idx,
         x.header, CASE WHEN x.side = 1 THEN r_name WHEN x.side = 2 AND x.row = 2 THEN r_name || ' > ' || c_name
                        WHEN x.side = 2 THEN r_name || ' > ' || n_name ELSE '' END AS sidebar
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
  (VALUES (0,0,2,1,'Region','title',0,'',0), (0,1,2,1,'Owner','title',1,'',0),
          (0,2,1,2,'Account','title',2,'',0),
          (1,2,1,1,'Balance','title',0,'Account',0), (1,3,1,1,'Segment','title',1,'Account',0),
          (2,0,2,1,'region','sidebar',0,'Region',0), (2,1,1,1,'name','sidebar',1,'Owner',1),
          (2,2,1,1,'bal','data',2,'Account > Balance',2), (2,3,1,1,'seg','data',3,'Account > Segment',2),
          (3,1,1,1,'nation','sidebar',0,'Owner',1),
          (3,2,1,1,'bal2','data',1,'Account > Balance',2),
          (3,3,1,1,'seg','data',2,'Account > Segment',2))
    AS x(row, col, rowspan, colspan, t, role, src_idx, header, side))
"""

# ---------------------------------------------------------------- events
# shape, table, verdict, status, orientation, span-free; cells of each type;
# cells of each role; rows; code of the objection
_SHAPES = [
    # v t verdict          status      orient  plain  num form str media oth none link  ti si da re rows
    (0, 0, "genuine", "ok", "top", True, 2, 0, 4, 0, 0, 0, 0, 2, 2, 2, 0, 3),
    (1, 0, "genuine", "ok", "top", True, 2, 0, 5, 0, 0, 1, 0, 2, 3, 3, 0, 4),
    (2, 0, "genuine", "ok", "top", True, 0, 0, 5, 0, 0, 0, 1, 2, 2, 2, 0, 3),
    (3, 0, "genuine", "ok", "top", True, 0, 0, 4, 2, 0, 0, 0, 2, 2, 2, 0, 3),
    (4, 0, "DataTypeError", "ok", None, True, 1, 0, 7, 1, 0, 0, 0, 0, 0, 0, 0, 3),
    (5, 0, "TitleTypeError", "ok", None, True, 2, 1, 3, 0, 0, 0, 0, 0, 0, 0, 0, 3),
    (6, 0, "DataTypeError", "ok", None, True, 2, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 3),
    (7, 0, "genuine", "ok", "top", True, 2, 0, 4, 0, 0, 0, 0, 2, 2, 2, 0, 3),
    (8, 0, "LayoutError", "ok", None, False, 2, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 4),
    (9, 0, "LayoutError", "ok", None, False, 2, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 3),
    (10, 0, "LayoutError", "ok", None, False, 2, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (11, 0, "LayoutError", "ok", None, False, 4, 0, 10, 0, 1, 0, 1, 0, 0, 0, 0, 5),
    (11, 1, "genuine", "ok", "top", True, 2, 0, 4, 0, 0, 0, 0, 2, 2, 2, 0, 3),
    (12, 0, "error", "bad_span", None, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (14, 0, "genuine", "ok", "top", False, 2, 0, 5, 0, 0, 0, 0, 3, 2, 2, 0, 4),
    (15, 0, "DataTypeError", "ok", None, False, 2, 0, 7, 0, 0, 0, 1, 0, 0, 0, 0, 4),
    (16, 0, "genuine", "ok", "left", True, 2, 0, 5, 0, 0, 1, 0, 4, 0, 4, 0, 4),
    (17, 0, "genuine", "ok", "top", False, 4, 0, 9, 0, 0, 0, 0, 3, 2, 6, 2, 5),
    (18, 0, "genuine", "ok", "top", True, 2, 2, 5, 0, 0, 0, 0, 3, 2, 4, 0, 3),
    (19, 0, "TitleTypeError", "ok", None, True, 1, 0, 4, 1, 0, 0, 0, 0, 0, 0, 0, 3),
    (20, 0, "genuine", "ok", "top", False, 2, 0, 5, 0, 0, 0, 0, 2, 2, 3, 0, 3),
    (21, 0, "genuine", "ok", "top", False, 0, 0, 9, 0, 0, 0, 1, 3, 4, 3, 0, 4),
    (22, 0, "LayoutError", "ok", None, False, 3, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 4),
    (23, 0, "error", "error", None, False, 3, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 4),
]


def _lit(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else \
        f"'{x}'" if isinstance(x, str) else str(x)


_V = "CAST(round(value * 100) AS BIGINT)"
_T = fixed.VERDICT_TEXTS


def _say(code: str, *values: str, noun: str = "") -> str:
    """A verdict text as an SQL expression; values are SQL."""
    text = _T[code].replace("'", "''").replace("{H}", noun)
    for i, value in enumerate(values):
        text = text.replace("{%d}" % i, f"' || {value} || '")
    return "'" + text.replace("\\n", "\n") + "'"


_MESSAGES = {
    4: ("DataTypeError", _say("column_type", _V, "'DIMENSION'", "''", "'PHOTO'")),
    5: ("TitleTypeError", _say("bad_type", "'Go'", "'FORM'", noun="заголовок")),
    6: ("DataTypeError", _say("column_type", f"{_V} || '%'", "'PERCENT'", f"'$' || {_V}", "'MONEY'")),
    8: ("LayoutError", _say("overrun", "'7'", "'3'")),
    9: ("LayoutError", _say("close_short", "'1'", "'Note'")),
    10: ("LayoutError", _say("small", "'1'", "'4'")),
    11: ("LayoutError", _say("close_left", "'1'", "'2'", "'8'")),
    12: ("ValueError", "'invalid literal for int() with base 10: ''wide'''"),
    15: ("DataTypeError", _say("column_type", _V, "'DIMENSION'", "event_type", "'LINK'")),
    19: ("TitleTypeError", _say("bad_type", "'2024'", "'GENUINE'", noun="заголовок")),
    22: ("LayoutError", _say("side_only")),
    23: ("ValueError", _say("bad_row_span")),
}
_MESSAGE = "CASE WHEN s.t = 1 THEN NULL " + " ".join(
    f"WHEN s.v = {v} THEN '{kind}: ' || {text}" for v, (kind, text) in _MESSAGES.items()) + " END"

EV = f"""
shapes AS (SELECT * FROM (VALUES {", ".join(
    "(" + ", ".join(_lit(x) for x in s) + ")" for s in _SHAPES)})
  AS s(v, t, verdict, status, orientation, plain, numeric, form, string, media, other, no_data,
       link, titles, sidebars, data, results, n_rows)),
ev AS (
  SELECT event_id, event_id * 4 + 3 AS page_id, s.t AS table_idx, s.*, event_type, {_V} AS cents,
         numeric + form + string + media + other + no_data + link AS n_cells,
         {_MESSAGE} AS message
  FROM events JOIN shapes s ON s.v = event_id % 24)
"""

# ---------------------------------------------------------------- labels
# Also the rule by which the records are made: plain SQL that both engines read.
GOOD_SHAPES = "(0, 1, 4, 6, 7, 11, 14, 16, 17, 20, 21)"
LABEL = (f"CASE WHEN event_id % 7 = 0 THEN 'None' WHEN (event_id % 24 IN {GOOD_SHAPES}) <> "
         f"(event_id % 13 = 0) THEN 'genuine' ELSE 'no genuine' END")
LAB = f"""
lab AS (SELECT event_id, event_id::VARCHAR AS key, 'Record ' || event_id AS name, {LABEL} AS verification
        FROM events WHERE event_id % 19 <> 0),
lab_v AS (SELECT lab.*, coalesce(ev.verdict, 'LayoutError') AS verdict,
                 CASE WHEN ev.verdict IS NULL THEN 'LayoutError: {fixed.NO_TABLE_IN_RECORD}'
                      ELSE ev.message END AS message
          FROM lab LEFT JOIN ev ON ev.event_id = lab.event_id AND ev.table_idx = 0
          WHERE verification <> 'None')
"""

# ---------------------------------------------------------------- texts and their types
TEXT_SHAPES = [
    "v", "v || ' см'", "v || ' m²'", "'$' || v", "v || ' руб.'", "v || '%'",
    "'2024-01-' || (id % 28 + 1)", "(id % 28 + 1) || ' января 2024'",
    "'Jan. ' || (id % 28 + 1) || ', 2024'", "'Feb ''25'", "'Nov ’25'", "'14:30:05'", "'2:30 pm'",
    "'5 ' || v", "'1,368,' || (id % 900 + 100)", "'1.368.' || (id % 900 + 100) || ',5'",
    "'154,977'", "',78'", "'- ' || v || '.5'", "'12 12 123'", "'n/a'", "'—'", "' '",
    "'слово ' || v || ' слово'", "v || ' USD'", "v || ' рубль'", "v || ' км/ч'",
    "'Модель 2024 версия 3.5'", "'Out since Mar ''25 with elbow pain'", "'12 ' || v",
    "v || 'kg'", "'25°C'", "'2024 December 31'", "'мая ' || v", "'март, 2024'", "'МАРТА 2024'",
    "'12 123,5'", "'+.5'", "'1 2 3,25'", "'12:5'", "'$ and %'", "'-'", "'NA'", "'na'",
]
TEXT_CASE = "CASE id % {n} {whens} END".format(
    n=len(TEXT_SHAPES), whens=" ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEXT_SHAPES)))
TEXTS = f"""
texts AS (
  SELECT 'shape' AS src, id, {TEXT_CASE} AS text
  FROM (SELECT event_id AS id, {_V}::VARCHAR AS v FROM events)
  UNION ALL
  SELECT 'line', doc_id * 100000 + i, line
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL
  SELECT 'turn', conv_id * 100000 + turn, text FROM conversations)
"""
_S = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"\p{L}\p{N}_"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for RE2, which has no look-around: a word edge takes the character beside it."""
    body = pattern.replace(r"[,\s]", f"[,{_S}]").replace(r"\s", f"[{_S}]").replace(r"\d", r"\p{Nd}")
    if body.startswith(r"\b"):
        body = rf"(?:^|[^{_W}])" + body[2:]
    body = body.replace(r"\b", rf"(?:$|[^{_W}])")
    return ("(?i)" if ignore_case else "") + body


def matches(patterns, ignore_case=False, text="text") -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(
        text, re2(p, ignore_case).replace("'", "''")) for p in patterns) + ")"


STRIPPED = rf"regexp_replace(text, '^[{_S}]+|[{_S}]+$', '', 'g')"
HIT = {
    "date": matches(fixed.DATE_PATTERNS, True),
    "time": matches(fixed.TIME_PATTERNS),
    "money": matches(fixed.MONEY_PATTERNS),
    "percent": matches([fixed.PERCENT_PATTERN]),
    "measurement": matches([fixed.MEASUREMENT_PATTERN], True),
    "dimension": matches(fixed.DIMENSION_PATTERNS),
    "no_data": STRIPPED + " IN (" + ", ".join(f"'{v}'" for v in fixed.NO_DATA_VALUES) + ")",
}
# Detail type of a text in a cell without any further tags.
DETAIL = "CASE WHEN {no_data} THEN 'NO_DATA' WHEN {date} THEN 'DATE' WHEN {time} THEN 'TIME' " \
         "WHEN {money} THEN 'MONEY' WHEN {percent} THEN 'PERCENT' WHEN {measurement} THEN " \
         "'MEASUREMENT' WHEN {dimension} THEN 'DIMENSION' ELSE 'STRING' END".format(**HIT)


def coarse(detail: str) -> str:
    whens = " ".join("WHEN {} IN ({}) THEN '{}'".format(
        detail, ", ".join(f"'{d}'" for d in ds), c) for c, ds in fixed.COARSE_OF_DETAIL.items())
    return f"CASE {whens} ELSE 'OTHER' END"


# Sets of tags that events cycle through, with the answers the tag predicates give.
TAG_SETS = [  # tags, only formatting, only formatting or link, button, input box
    ("td", True, True, False, False), ("th,b,span", True, True, False, False),
    ("td,a", False, True, False, False), ("td,a,em", False, True, False, False),
    ("td,img", False, False, False, False), ("td,button", False, False, True, False),
    ("td,button,input,p", False, False, True, True), ("td,input", False, False, False, True),
    ("td,select", False, False, False, True), ("td,select,option", False, False, False, False),
    ("td,textarea,b", False, False, False, True), ("td,button,a", False, False, False, False),
    ("td,table,tr", False, False, False, False), ("td,video,source", False, False, False, False),
    ("td,audio", False, False, False, False), ("td,img,a", False, False, False, False),
    ("td,ul,li", False, False, False, False),
]


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
