"""What one cell holds, as native column expressions over (tags, text)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .regex import SPACE_CHARS, SPACES, java_regex
from .spans import SPAN_BITS


def _all_in(tags: Column, allowed: list[str]) -> Column:
    return F.forall(tags, lambda t: t.isin(allowed))


def _some_in(tags: Column, wanted: list[str]) -> Column:
    return F.exists(tags, lambda t: t.isin(wanted))


def _any_of(text: Column, patterns, ignore_case=False) -> Column:
    """One alternation rather than one test each: the text is decoded only once."""
    whole = "|".join(f"(?:{java_regex(p)})" for p in patterns)
    return text.rlike("(?iu)" + whole if ignore_case else whole)


def strip(text: Column) -> Column:
    """Remove Unicode white space on both ends (plain ``trim`` removes only U+0020)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def joined_text(pieces: Column) -> Column:
    """Cell text from its pieces: each stripped, blanks dropped, one space between."""
    return F.array_join(F.filter(F.transform(pieces, strip), lambda p: p != ""), " ")


def tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


@lru_cache(maxsize=1)
def decimal_digits() -> str:
    """The ten digits of every script, each from its zero on."""
    zeros = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.decimal(c, None) == 0]
    return "".join(chr(ord(z) + d) for z in zeros for d in range(10))


def parse_span(value: Column) -> Column:
    """Declared span: absent -> 1, unreadable -> null (the table is then ``bad_span``).

    An integer is an optional sign and digits of any script, with single underscores between
    them; one beyond ``SPAN_BITS`` bits, which no table can have, is unreadable too.
    """
    digits = decimal_digits()
    plain = F.translate(strip(value), digits, "0123456789" * (len(digits) // 10))
    whole = F.when(plain.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
                   F.regexp_replace(plain, "_", "").try_cast("bigint"))
    return F.when(value.isNull(), F.lit(1).cast("bigint")).otherwise(
        F.when(F.abs(whole) < (1 << SPAN_BITS), whole))


def only_formatting(tags: Column) -> Column:
    return _all_in(tags, fixed.CELL_TAGS + fixed.FORMATTING_TAGS)


def only_formatting_or_link(tags: Column) -> Column:
    return _all_in(tags, fixed.CELL_TAGS + fixed.FORMATTING_TAGS + ["a"])


def only_formatting_around_form(tags: Column) -> Column:
    return _all_in(tags, fixed.CELL_TAGS + fixed.FORMATTING_TAGS + fixed.FORM_TAGS)


def _says_nothing(text: Column) -> Column:
    """``strip(text)`` is one of the fixed values, by a pattern that fails at the first letter."""
    values = "|".join(re.escape(v) for v in fixed.NO_DATA_VALUES if v.strip())
    return text.rlike(rf"\A[{SPACES}]*+(?:{values})?[{SPACES}]*+\z")


def is_no_data(tags: Column, text: Column) -> Column:
    return _says_nothing(text) & only_formatting(tags)


def is_button(tags: Column) -> Column:
    return F.array_contains(tags, "button") & only_formatting_around_form(tags)


def is_input_box(tags: Column) -> Column:
    return _some_in(tags, fixed.INPUT_TAGS) & only_formatting_around_form(tags)


def media_kind(tags: Column, text: Column) -> Column:
    """PHOTO / VIDEO / AUDIO for media without text, else null."""
    kind = (F.when(F.array_contains(tags, "img"), "PHOTO")
            .when(F.array_contains(tags, "video"), "VIDEO")
            .when(F.array_contains(tags, "audio"), "AUDIO"))
    return F.when(strip(text) == "", kind)


def is_mixed(tags: Column, text: Column) -> Column:
    media = _some_in(tags, ["img", "video", "audio"])
    return media & (F.array_contains(tags, "a") | (F.char_length(strip(text)) > 3))


def is_date(text: Column) -> Column:
    """Every pattern needs a digit next to a word or behind an apostrophe, or one or two digits between two separators:
    one plain test spares most texts."""
    near = rf"\p{{L}}[.,]{{0,2}}[{SPACES}]\p{{Nd}}|\p{{L}}[.,]{{0,2}}[{SPACES}]{{2}}|\p{{Nd}}[{SPACES}]+\p{{L}}|['’]\p{{Nd}}"
    return text.rlike(near + r"|[-/.\\ ]\p{Nd}{1,2}[-/.\\ ]") & _any_of(text, fixed.DATE_PATTERNS, ignore_case=True)


def is_time(text: Column) -> Column:
    return text.contains(":") & _any_of(text, fixed.TIME_PATTERNS)


def is_money(text: Column) -> Column:
    """Every pattern needs a sign, or white space before a letter that some currency begins with."""
    return text.rlike(rf"[$€£¥₽]|[{SPACES}][UEGJRuegjrр]") & _any_of(text, fixed.MONEY_PATTERNS)


def is_percent(text: Column) -> Column:
    return text.contains("%") & text.rlike(java_regex(fixed.PERCENT_PATTERN))


def is_measurement(text: Column) -> Column:
    return text.rlike(java_regex(fixed.MEASUREMENT_PATTERN, ignore_case=True))


def is_dimension(text: Column) -> Column:
    """A text with anything but digits, white space and these four signs meets no pattern."""
    return text.rlike(rf"\A[{SPACES}\p{{Nd}}.,+\-]++\z") & _any_of(text, fixed.DIMENSION_PATTERNS)


def number_kind(text: Column) -> Column:
    """First matching number-like type, else null. Every pattern needs a digit,
    so one cheap test spares digit-free texts all the others; all but the last need
    something else besides, so another spares texts of mere digits."""
    kind = (F.when(text.rlike(r"^[0-9]+\z"), "DIMENSION")
            .when(is_date(text), "DATE")
            .when(is_time(text), "TIME")
            .when(is_money(text), "MONEY")
            .when(is_percent(text), "PERCENT")
            .when(is_measurement(text), "MEASUREMENT")
            .when(is_dimension(text), "DIMENSION"))
    return F.when(text.rlike(r"\p{Nd}"), kind)


def detail_type(tags: Column, text: Column) -> Column:
    """One of the 16 detail types; the first rule that holds decides.

    A cell without elements in it, the common case, can meet only the rules about texts.
    """
    bare = (F.size(tags) == 1) & F.get(tags, F.lit(0)).isin(fixed.CELL_TAGS)
    plain = F.when(_says_nothing(text), "NO_DATA").otherwise(
        F.coalesce(number_kind(text), F.when(text.isNotNull(), "STRING"), F.lit("OTHER")))
    return (F.when(bare, plain)
            .when(is_no_data(tags, text), "NO_DATA")
            .when(is_button(tags), "BUTTON")
            .when(is_input_box(tags), "INPUT_BOX")
            .otherwise(F.coalesce(
                media_kind(tags, text),
                F.when(is_mixed(tags, text), "MIXED"),
                F.when(only_formatting_or_link(tags), F.coalesce(
                    number_kind(text),
                    F.when(F.array_contains(tags, "a"), "LINK"))),
                F.when(only_formatting(tags) & (strip(text) != ""), "STRING"),
                F.lit("OTHER"))))


def coarse_type(detail: Column) -> Column:
    """One of the 7 coarse types for a detail type."""
    out = None
    for coarse, details in fixed.COARSE_OF_DETAIL.items():
        test = detail.isin(details)
        out = F.when(test, coarse) if out is None else out.when(test, coarse)
    return out.otherwise("OTHER")


def parse_dimension(text: Column) -> Column:
    """Number written in ``text``, read by the first shape it matches; else null."""
    compact = F.regexp_replace(text, rf"[{SPACES}]+", "")
    as_point = F.regexp_replace(compact, ",", ".")
    no_commas = F.regexp_replace(compact, ",", "")
    european = F.regexp_replace(F.regexp_replace(compact, r"\.", ""), ",", ".")
    readings = [compact, as_point, compact, as_point, as_point, no_commas, european]
    out = None
    for pattern, reading in zip(fixed.DIMENSION_PATTERNS, readings):
        test, value = text.rlike(java_regex(pattern)), reading.try_cast("double")
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def cell_value(detail: Column, text: Column) -> Column:
    return F.when(detail == "DIMENSION", parse_dimension(text))


def types_compatible(parent: Column, child: Column) -> Column:
    text_like = ["LINK", "STRING"]
    return ((parent == child) | (parent == "NO_DATA") | (child == "NO_DATA")
            | (parent.isin(text_like) & child.isin(text_like)))


def column_kind(detail: Column) -> Column:
    """Detail type with LINK read as STRING and empty cells as null."""
    return F.when(detail == "LINK", "STRING").when(detail != "NO_DATA", detail)


def is_summable(detail: Column) -> Column:
    return detail.isin(fixed.SUMMABLE_TYPES)


