import math

from pyspark.sql import functions as F

from tablemill.functions import cell_types as ct
from tablemill.sources import tables

DETAIL = {
    "NO_DATA": ["", "  ", "-", "—", "n/d", "N/A", "н/д", "н/a", "NA", "n/a", "<b></b>", "<br>",
                "&nbsp;"],
    "STRING": ["plain", "<b>bold</b> and <i>slanted</i>", "$", "%", "Модель 2024 версия 3.5",
               "Out since Mar '25 with elbow pain", "-12 см", "na", "Block 1", "12 рубля",
               "<h3>head</h3>", "н/Д"],
    "BUTTON": ["<button></button>", "<button><b>Go</b></button>", "<button>a</button><input>"],
    "INPUT_BOX": ["<input type='text'/>", "<textarea></textarea>", "<b><input></b>",
                  "<select></select>"],
    "PHOTO": ["<img src='a.png'>", "<a href='#'><img></a>"],
    "VIDEO": ["<video><source src='v'/></video>"],
    "AUDIO": ["<audio controls></audio>"],
    "MIXED": ["<img>long text", "<img><a href='#'>x</a>", "<video></video>Описание"],
    "OTHER": ["<img>abc", "<ul><li>1</li></ul>", "<select><option>1</option></select>",
              "<button>a</button><a>b</a>"],
    "DATE": ["2024-01-15", "15.01.2024", "15/01/2024", "01-15-2024", "12.20.1980", "12 12 123",
             "15 января 2024", "10 мая 2024", "ДЕКАБРЬ 2024", "сен 2024", "January 15, 2024",
             "Dec 31, 2024", "2024 January", "Feb '25", "Sept. '24", "Nov ’25", "<b>2024-01-15</b>",
             "<a href='#'>15 января 2024</a>"],
    "TIME": ["14:30", "00:00", "9:15:30.123", "2:30 PM", "at 02:30 am"],
    "MONEY": ["$100.50", "100$", "€50", "¥1000", "₽500", "100 USD", "12 руб.", "1 000 руб", "7 р"],
    "PERCENT": ["75%", "0,5 %", "about 3%"],
    "MEASUREMENT": ["10 см", "12.5 mm", "100 км", "5.5 inches", "250 кг", "25°C", "100 Вт", "220 В",
                    "50 Гц", "9 м²", "9 М²", "3 sq m", "5 ГБ", "<a>12 см</a>"],
    "DIMENSION": ["12", "-12", "- 12", "12,5", "1000", "5 880", "12 123,5", ",78", "+.5",
                  "1,368,524", "1.368.524,5", "154,977", "<b>999.99</b>", "12&nbsp;123", "٣٤"],
    "LINK": ["<a href='#'>link</a>", "<b><a>bold</a></b>", "<a></a>"],
}


def test_detail_types(spark, as_pages):
    cases = [(t, d) for d, texts in DETAIL.items() for t in texts]
    pages = as_pages([f"<table><tr><td>{t}</td></tr></table>" for t, _ in cases])
    cells = tables.extract_cells(tables.type_tables(tables.extract_tables(pages)))
    found = {r.page_id: r for r in cells.collect()}
    wrong = [(t, d, found[i].detail) for i, (t, d) in enumerate(cases) if found[i].detail != d]
    assert not wrong
    coarse = {"NO_DATA": "NO_DATA", "BUTTON": "FORM", "MIXED": "MEDIA", "DATE": "GENUINE",
              "LINK": "LINK", "OTHER": "OTHER", "STRING": "STRING"}
    for i, (_, d) in enumerate(cases):
        assert coarse.get(d, found[i].type) == found[i].type


def test_numbers(spark):
    cases = {"12": 12, "-12": -12, "12,5": 12.5, "5 880": 5880, "12 123,5": 12123.5, ",78": 0.78,
             "1,368,524": 1368524, "1.368.524,5": 1368524.5, "154,977": 154.977, "- 7": -7,
             "Итого": None, "12 см": None, "1 2 3.5": 123.5}
    rows = spark.createDataFrame([(t, None if v is None else float(v)) for t, v in cases.items()],
                                 "text string, expected double")
    for r in rows.withColumn("got", ct.parse_dimension(F.col("text"))).collect():
        if r.expected is None:
            assert r.got is None
        else:
            assert math.isclose(r.got, r.expected)


def test_long_number_lists_do_not_recurse(spark):
    rows = spark.range(1).select(F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(60000)), lambda x: F.lit("77777")), " ").alias("text"))
    got = rows.select(ct.number_kind(F.col("text")).alias("k")).first().k
    assert got == "DIMENSION"


def test_strip_and_spans(spark):
    rows = spark.createDataFrame([(" a  ",), ("\x1cb\x1f",)], "t string")
    assert [r.t for r in rows.select(ct.strip(F.col("t")).alias("t")).collect()] == ["a", "b"]
    spans = spark.createDataFrame([(None,), (" 3 ",), ("x",)], "t string")
    assert [r.s for r in spans.select(ct.parse_span(F.col("t")).alias("s")).collect()] == [1, 3, None]


def test_plain_tests_spare_no_match(spark):
    """The tests put before patterns and in place of ``strip`` change no answer."""
    import random

    from tablemill import fixed
    rng = random.Random(5)
    bits = ["1", "22", "2024", "٣", "март", "March", "Jan", "мая", "SEP", "ſep", ".", ",", " ", "  ", "\u00a0", "\u1680", "\n", "\x85", "\x1f", "'", "’", "/", "-",
            "+", "$", "₽", "USD", "usd", "руб", "р", "eur", "x", ":", "\\", "n/a", "NA", "—", "н/д", "n/d", "%", "кг"]
    texts = ["", " ", "-\n", "\n\n—", *{"".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(20000)}]
    text = F.col("text")
    plainly = {
        "date": (ct.is_date(text), ct._any_of(text, fixed.DATE_PATTERNS, ignore_case=True)),
        "money": (ct.is_money(text), ct._any_of(text, fixed.MONEY_PATTERNS)),
        "dimension": (ct.is_dimension(text), ct._any_of(text, fixed.DIMENSION_PATTERNS)),
        "no data": (ct._says_nothing(text), ct.strip(text).isin(fixed.NO_DATA_VALUES))}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, (ours, plain) in plainly.items():
        both = rows.select("text", ours.alias("ours"), plain.alias("plain")).cache()
        assert [r.text for r in both.where("ours <> plain").collect()] == [], name
        assert both.where("plain").count() > 5 and both.where("NOT plain").count() > 5
        both.unpersist()
